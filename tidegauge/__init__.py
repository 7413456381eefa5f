"""Spark-native analytics over event tables, half-open time segments and sampled signals."""
