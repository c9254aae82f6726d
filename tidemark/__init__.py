"""Tidemark: relational, time-series and batch-inference analytics on Spark DataFrames."""
