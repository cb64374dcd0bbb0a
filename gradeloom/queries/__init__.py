"""Driver queries with their SQL."""
