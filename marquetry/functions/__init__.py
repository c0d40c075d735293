"""Scalar functions, as Column builders and SQL text."""
