"""Structured Streaming rounds."""
