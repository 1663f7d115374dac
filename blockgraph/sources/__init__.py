"""Readers and writers of graph and block files."""
