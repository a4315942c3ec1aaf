"""Spark-first engine for designing training-data mixtures."""
