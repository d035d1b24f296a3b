"""Incremental operators as Structured Streaming jobs."""
