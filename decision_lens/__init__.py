"""Decision explanation analytics on Spark DataFrames."""
