"""Property-graph and relational analytics on Spark DataFrames."""
