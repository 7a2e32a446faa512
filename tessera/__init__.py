"""A Spark-native engine for analytical queries over columnar tables."""

__version__ = "0.1.0"
