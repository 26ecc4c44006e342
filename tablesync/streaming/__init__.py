"""Structured Streaming front end of the pull."""
