"""Objectives as column expressions."""
