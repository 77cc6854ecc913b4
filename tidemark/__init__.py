"""Tidemark: a PySpark-native engine for growth-signal analytics over register-style tables."""

__version__ = "0.1.0"
