"""Spark operators for gridded environmental data in long form.

A grid is a DataFrame with one row per cell: ``time``, ``lat``, ``lon`` and one
DOUBLE column per variable, missing values as NULL.  Every operator takes and
returns DataFrames and leaves the physical plan to Catalyst.
"""
