"""Structured Streaming forms of the change operators."""
