"""Continuous ingest of report files."""
