"""Structured Streaming counterparts of the run-time sources."""
