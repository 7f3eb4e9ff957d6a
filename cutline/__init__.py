"""Spark engine for ranked cutoffs that are published by entity, category, stage and year."""
