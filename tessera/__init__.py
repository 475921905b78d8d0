"""Tessera: a PySpark-native engine for linking noisy records to reference entities."""
