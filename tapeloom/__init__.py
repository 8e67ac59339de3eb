"""Spark-native analytics for market time series and large text corpora."""
