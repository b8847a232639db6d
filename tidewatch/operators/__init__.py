"""Operators, each a plain function from DataFrames or Columns to a DataFrame or Column."""
