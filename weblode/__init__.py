"""Spark-native engine turning web content into scored, chunked retrieval documents."""
