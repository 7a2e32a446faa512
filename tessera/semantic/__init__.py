"""Datasets, metrics and relationships in YAML or JSON, compiled to DataFrames and SQL."""
