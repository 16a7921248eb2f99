"""Operators on streaming DataFrames."""
