"""Sluicebox: a Spark-native engine for transaction-feed captures and the lake built from them."""

__version__ = "0.1.0"
