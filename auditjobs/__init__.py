"""Batch and streaming Spark jobs over code-audit data."""
