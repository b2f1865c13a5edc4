"""Actuarial and array analytics on Spark DataFrames."""
