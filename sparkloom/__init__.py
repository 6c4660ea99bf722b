"""Spark-native processing of web pages and text corpora."""
