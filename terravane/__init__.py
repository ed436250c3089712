"""Collateral-risk analytics expressed as Spark DataFrames, SQL and Structured Streaming."""
