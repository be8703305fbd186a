"""Structured Streaming over snapshot files."""
