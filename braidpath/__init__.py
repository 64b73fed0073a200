"""Path-signature analytics as Spark DataFrame operators."""
