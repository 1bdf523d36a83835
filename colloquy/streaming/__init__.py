"""Incremental importing on Structured Streaming."""
