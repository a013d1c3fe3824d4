"""Spark-native curation of large catalogues of time-series sequences."""
