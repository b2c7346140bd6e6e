"""Operators on text and terms. Nothing else in the library imports this package."""
