"""Relational operators as transformations of DataFrames."""
