"""loomtext: document analytics on Spark DataFrames."""
