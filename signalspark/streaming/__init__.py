"""Structured Streaming forms of the per-worker operators."""
