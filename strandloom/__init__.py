"""Structural-hit analytics on Spark DataFrames."""
