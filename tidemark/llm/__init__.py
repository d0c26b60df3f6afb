"""Corpus operators for large training-data pipelines.

Each module holds one operator: a general function from DataFrames to
DataFrames plus the thin query that ``__spark_entry__`` registers.  Nothing
outside this subpackage imports it.
"""
