"""DataFrame operators over findings."""
