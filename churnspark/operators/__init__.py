"""Operators: DataFrame in, DataFrame or small metadata out."""
