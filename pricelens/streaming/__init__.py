"""Structured Streaming forms of the incremental jobs."""
