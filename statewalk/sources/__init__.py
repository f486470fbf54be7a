"""Fixed values, readers of the given tables, and the stored path tables."""
