"""Operators for preparing training text, each a function from DataFrames to DataFrames."""
