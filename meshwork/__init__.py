"""Spark-native graph analytics: every operator is a function from DataFrames to a DataFrame."""
