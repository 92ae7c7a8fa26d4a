"""Continuous analysis with Structured Streaming."""
