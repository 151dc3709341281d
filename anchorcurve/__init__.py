"""Positional co-occurrence profiles on Spark DataFrames."""
