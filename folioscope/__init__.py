"""Spark-native analytics over tables of document pages."""
