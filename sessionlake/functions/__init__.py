"""Column builders: each takes columns and returns columns."""
