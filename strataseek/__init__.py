"""Hybrid retrieval and graph analytics on Spark DataFrames."""
