"""Operators for building text training data."""
