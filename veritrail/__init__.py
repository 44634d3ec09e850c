"""Spark-native analytics for illicit-finance investigation."""
