"""Spark-native document and credit-metrics analytics."""
