"""Sensitive-data detection, masking and restoration over Spark DataFrames."""

__version__ = "0.1.0"
