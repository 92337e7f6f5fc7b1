"""Operators: DataFrames in, a lazy DataFrame out."""
