"""Spark-native analytics of text-to-region datasets."""
