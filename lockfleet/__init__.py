"""Lockfile analytics at fleet scale, on Spark DataFrames."""
