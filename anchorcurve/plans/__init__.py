"""Plans of the positional profile engine."""
