"""Manufacturing analytics on Spark DataFrames."""
