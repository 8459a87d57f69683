"""Spark-native document corpora: ingestion, retrieval, evaluation and usage analytics."""
