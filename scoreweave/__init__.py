"""Spark-native credit-risk analytics."""
