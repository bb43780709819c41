"""Disclosure control and training-data operators on Spark DataFrames."""
