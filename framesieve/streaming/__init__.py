"""Structured Streaming forms of session operators."""
