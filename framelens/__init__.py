"""Spark-native analytics for long series of one-dimensional patterns."""
