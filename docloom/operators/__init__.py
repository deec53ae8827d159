"""Operators of the document-to-knowledge engine: DataFrames in, DataFrames out."""
