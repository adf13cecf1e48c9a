"""Spark-native analytics for long-form text and narrated audio."""
