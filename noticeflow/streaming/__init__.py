"""Structured Streaming faces of the incremental operators."""
