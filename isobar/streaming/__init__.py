"""Structured Streaming forms of reductions."""
