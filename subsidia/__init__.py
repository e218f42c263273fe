"""Spark-native analytics for satellite ground-motion data."""
