"""Metadata, code and text search as Spark jobs."""
