"""Spark-native building blocks of the signal engine."""
