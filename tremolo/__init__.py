"""Spark jobs for testing how a classifier over dialogue data stands up to noise."""
