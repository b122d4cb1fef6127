"""Structured Streaming form of the incremental steps."""
