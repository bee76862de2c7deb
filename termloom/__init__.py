"""Spark-native analytics for terminology in collections of short texts."""
