"""Spark-native analytics for sensor logs, point clouds and pose graphs."""
