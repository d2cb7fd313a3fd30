"""palio: pairwise-ranking analytics on Spark DataFrames."""
