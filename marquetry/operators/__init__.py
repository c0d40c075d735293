"""Relational operators: keyed DataFrame in, DataFrame out."""
