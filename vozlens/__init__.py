"""Spark-native engine for auditing spoken corpora and the models evaluated on them."""

__version__ = "0.1.0"
