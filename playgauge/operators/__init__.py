"""Analytic operators: DataFrames in, one DataFrame out."""
