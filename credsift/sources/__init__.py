"""Report readers and lookup tables."""
