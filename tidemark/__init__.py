"""Tidemark: market time series, point-in-time facts and filing documents on Spark."""
