"""Operators of the verification: DataFrame in, DataFrame out."""
