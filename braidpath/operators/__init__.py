"""Operators of the path-signature engine."""
