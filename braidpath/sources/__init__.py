"""Sources of the path-signature engine."""
