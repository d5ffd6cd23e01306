"""Spark-native analytics for multi-band image series."""
