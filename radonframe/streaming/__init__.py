"""Structured Streaming over event tables."""
