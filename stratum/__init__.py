"""Spark-native code-health analytics: every analytic is a function from DataFrames to a DataFrame."""

__version__ = "0.1.0"
