"""Structured Streaming forms of the keyed merges."""
