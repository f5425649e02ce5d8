"""Spark-native analytics over multi-country retail price observations."""
