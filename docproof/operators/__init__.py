"""docproof: operators."""
