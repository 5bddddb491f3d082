"""Structural data mapping on Spark DataFrames."""
