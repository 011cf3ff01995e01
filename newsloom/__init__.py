"""News-and-policy analytics on Spark DataFrames."""
