"""Exact aggregation analytics over event logs and long documents, on Spark DataFrames."""
