"""Spark-native experimentation, journey and time-series analytics."""
