"""Spark-native analytics over recordings of many simultaneous time series."""
