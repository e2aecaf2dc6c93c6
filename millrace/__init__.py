"""Spark-native analytics over a distributed task-execution and result-caching cluster."""
