"""Spark-native approximate dictionary search."""
