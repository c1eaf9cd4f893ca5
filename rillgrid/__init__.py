"""Spark-native analytics over long-format raster and time-series tables."""
