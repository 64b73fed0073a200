"""Streaming of the path-signature engine."""
