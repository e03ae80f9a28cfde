"""Distributed text and subword-token analytics on PySpark DataFrames."""

__version__ = "0.1.0"
