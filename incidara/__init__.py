"""Spark-native analytics for incident and service-call feeds."""

__version__ = "0.1.0"
