"""Structured Streaming twins of the live-metric operators."""
