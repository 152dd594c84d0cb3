"""docproof: sources."""
