"""Taste-driven event discovery and training-data preparation as Spark DataFrame jobs."""
