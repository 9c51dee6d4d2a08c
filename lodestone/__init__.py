"""Lodestone: a PySpark-native retrieval and conversation-analytics engine."""
