"""Progress-aware text and temporal-graph analytics on Spark DataFrames."""
