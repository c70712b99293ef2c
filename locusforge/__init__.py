"""Spark-native marker association analytics."""

__version__ = "0.1.0"
