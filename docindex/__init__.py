"""Typed nested documents and application-managed secondary indices on Spark DataFrames."""
