"""Spark-native corpus preparation and evaluation engine."""
