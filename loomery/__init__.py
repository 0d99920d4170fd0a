"""Spark-native corpus, fact-index and run analytics."""
