"""Shortest-path tables, ordered folds and path lookups as Spark jobs."""
