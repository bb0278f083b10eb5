"""Spectrafold: a PySpark-native engine for scientific tables, text and event streams."""
