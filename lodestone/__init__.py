"""Spark-native retrieval analytics: declarative operators over DataFrames."""
