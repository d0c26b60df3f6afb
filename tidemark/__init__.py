"""Spark-native fund and equity analytics engine."""
