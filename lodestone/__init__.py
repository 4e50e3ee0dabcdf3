"""Spark-native document retrieval, answer verification and corpus preparation."""
