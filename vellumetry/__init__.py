"""Spark-native analytics for scanned pages, recognised text and saved page-layout projects."""

__version__ = "0.1.0"
