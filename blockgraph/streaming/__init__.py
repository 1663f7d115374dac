"""Graphs that grow by streams of edges."""
