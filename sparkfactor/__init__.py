"""Spark-native factor discovery and evaluation engine."""

__version__ = "0.1.0"
