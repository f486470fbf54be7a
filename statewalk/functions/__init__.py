"""Column-building functions; nothing here triggers a job."""
