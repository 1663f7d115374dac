"""Operators over graphs and assignments."""
