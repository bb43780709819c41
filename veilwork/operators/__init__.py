"""Masks and metrics: DataFrame in, DataFrame or number out."""
