"""Spark-native record pipelines for text-heavy tables."""
