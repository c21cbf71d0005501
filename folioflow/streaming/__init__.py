"""Structured Streaming forms of the job queries and of the conversion."""
