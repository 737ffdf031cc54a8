"""Spark-native engine for place-based data work (see README.md)."""
