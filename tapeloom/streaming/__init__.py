"""Structured Streaming forms of the manifest operators."""
