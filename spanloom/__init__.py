"""Spanloom: a Spark-native engine for source-backed document facts."""
