"""Lodestone: a PySpark-native engine for corpus retrieval and rule-based source triage."""
