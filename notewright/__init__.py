"""A PySpark-native analytics engine for corpora of linked text notes."""

__version__ = "0.1.0"
