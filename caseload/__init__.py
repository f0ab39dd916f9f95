"""Spark-native analytics for document-review decisions."""
