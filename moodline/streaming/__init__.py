"""Structured Streaming jobs over the ``events`` stream."""
