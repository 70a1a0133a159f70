"""Structured Streaming use of the row-wise operators (the reference has no streaming)."""
