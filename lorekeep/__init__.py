"""Spark-native versioned record store, query compiler and recall engine."""
