"""Streaming of the positional profile engine."""
