"""Sequence-to-reference matching and corpus processing as Spark DataFrames."""

__version__ = "0.1.0"
