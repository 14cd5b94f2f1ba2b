"""Spark-native retrieval evaluation: spans, chunks, relevance judgments, runs and ranking metrics."""
