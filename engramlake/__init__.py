"""Engramlake: a PySpark-native memory analytics and corpus engine."""
