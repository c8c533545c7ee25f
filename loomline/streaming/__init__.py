"""Structured Streaming forms of the document operators."""
