"""Spark-native postings analytics and evaluation engine."""

__version__ = "0.1.0"
