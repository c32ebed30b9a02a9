"""Structured Streaming jobs.  They use the same column functions as the batch jobs."""
