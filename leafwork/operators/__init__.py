"""Operators: DataFrame in, DataFrame out."""
