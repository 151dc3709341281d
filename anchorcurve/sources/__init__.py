"""Sources of the positional profile engine."""
