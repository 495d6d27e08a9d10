"""Incremental evaluation with Structured Streaming."""
