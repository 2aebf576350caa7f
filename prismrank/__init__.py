"""Spark-native analytics for diversity-aware retrieval."""
