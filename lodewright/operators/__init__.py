"""Operators on triple tables."""
