"""docproof: functions."""
