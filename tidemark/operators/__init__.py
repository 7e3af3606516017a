"""Operators: pure functions from DataFrames to DataFrames, over all steps at once."""
