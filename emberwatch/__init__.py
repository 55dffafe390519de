"""Spark-native incident analytics over service telemetry."""

__version__ = "0.1.0"
