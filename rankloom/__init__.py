"""Spark-native click-log ranking analytics."""
