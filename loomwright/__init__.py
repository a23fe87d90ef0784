"""Spark-first analytics engine for entity resolution, search and corpus preparation."""

__version__ = "0.1.0"
