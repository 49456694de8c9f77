"""Type-graph analytics on Spark DataFrames."""
