"""Leafwright: document-extraction analytics as Spark DataFrames."""

__version__ = "0.1.0"
