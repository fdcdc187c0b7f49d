"""Spark-first hybrid retrieval, memory analytics and training-data engine."""
