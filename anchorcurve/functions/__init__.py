"""Functions of the positional profile engine."""
