"""Structured Streaming forms of the pipeline and of usage statistics."""
