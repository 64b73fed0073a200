"""Plans of the path-signature engine."""
