"""Spark-native text privacy analytics."""
