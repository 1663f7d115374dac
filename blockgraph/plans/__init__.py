"""Whole jobs: clustering on several levels, and reports."""
