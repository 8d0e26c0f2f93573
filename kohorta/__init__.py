"""Spark operators for coded longitudinal records."""

__version__ = "0.1.0"
