"""Spark-native operators for profiling, governing and auditing a data estate."""

__version__ = "0.1.0"
