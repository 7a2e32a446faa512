"""Scalar functions beyond what pyspark names directly."""
