"""Spark-native preparation, checking and summarising of training corpora."""
