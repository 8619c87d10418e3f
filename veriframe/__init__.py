"""Retrieval, matching, verification and evaluation analytics over Spark DataFrames."""
