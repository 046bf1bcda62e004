"""Spark-native engine for searching and preparing code and text corpora."""
