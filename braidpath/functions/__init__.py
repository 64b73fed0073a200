"""Functions of the path-signature engine."""
