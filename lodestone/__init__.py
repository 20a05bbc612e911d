"""A Spark-native full-text retrieval and corpus engine."""
