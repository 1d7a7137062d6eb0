"""Skein: a PySpark-native analytics engine for web corpora."""

__version__ = "0.1.0"
