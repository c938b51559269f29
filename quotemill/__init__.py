"""Spark-native processing of airfare quotes: cleaning, reconciliation, indices and data preparation."""

__version__ = "0.1.0"
