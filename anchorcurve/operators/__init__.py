"""Operators of the positional profile engine."""
