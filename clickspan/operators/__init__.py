"""Batch operators: each takes event DataFrames and returns a lazy DataFrame."""
