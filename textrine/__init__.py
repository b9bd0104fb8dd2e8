"""Textrine: string-index analytics on Spark DataFrames."""
