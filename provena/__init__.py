"""Spark-native text evidence analytics: see README.md."""
