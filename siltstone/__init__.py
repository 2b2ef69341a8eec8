"""Spark-native corpus processing, retrieval and evaluation engine."""
