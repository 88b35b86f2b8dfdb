"""Operators for training-data preparation over a ``documents`` table.

Every operator takes and returns DataFrames.  Nothing outside this subpackage imports it.
"""
