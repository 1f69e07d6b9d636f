"""Composed queries built from the operators."""
