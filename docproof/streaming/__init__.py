"""docproof: streaming."""
