"""Spark-native event analytics: lazy DataFrame operators for pitch-style event data."""

__version__ = "0.1.0"
