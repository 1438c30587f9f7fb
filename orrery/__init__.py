"""Compressed vector search and document retrieval on Spark DataFrames."""

__version__ = "0.1.0"
