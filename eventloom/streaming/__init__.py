"""Continuous pulls with Structured Streaming."""
