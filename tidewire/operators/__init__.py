"""Operators on flow rows: DataFrame in, DataFrame out."""
