"""Tessella: a PySpark-native analytics engine for large text corpora and the tables derived from them."""

__version__ = "0.1.0"
