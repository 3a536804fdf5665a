"""A PySpark-native knowledge-memory analytics engine."""

__version__ = "0.1.0"
