"""Partitioning of undirected weighted graphs on Spark DataFrames."""
