"""Credential findings on Spark: read, attribute, deduplicate and report."""
