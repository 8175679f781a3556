"""A Spark-native engine for building, curating and analysing document corpora."""

__version__ = "0.1.0"
