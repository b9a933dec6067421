"""Inputs derived from the given tables, queries over them, and their SQL twins."""
