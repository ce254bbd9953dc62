"""Spark-native visual timeline analytics."""

__version__ = "0.1.0"
