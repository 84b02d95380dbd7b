"""Spark-native analytics over wide measurement tables, graphs and training corpora."""

__version__ = "0.1.0"
