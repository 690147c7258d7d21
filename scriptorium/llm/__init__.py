"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` registers thin queries
over the supplied tables.
"""
