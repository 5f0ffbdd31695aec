"""Significant pattern mining and corpus preparation on Spark DataFrames."""
