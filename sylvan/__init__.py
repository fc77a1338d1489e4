"""Sylvan: a PySpark-native analytics engine for repositories of structured models."""
