"""Spark-native retrieval, fusion, ranking and corpus engine."""
