"""Granary: retrieval, filtering and corpus preparation as Spark DataFrame jobs."""
