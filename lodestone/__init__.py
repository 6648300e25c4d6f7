"""Lodestone: a PySpark-native engine for retrieval and analytics data work."""
