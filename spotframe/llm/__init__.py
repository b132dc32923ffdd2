"""Operators for large-scale text and model data. Nothing else in the library imports this."""
