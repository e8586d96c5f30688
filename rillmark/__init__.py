"""Spark-native mediation of operational data."""
