"""Typed, de-duplicated triple graphs from tables, as PySpark DataFrame jobs."""
