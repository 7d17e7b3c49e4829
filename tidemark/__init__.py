"""Market-measurement analytics on Spark DataFrames."""
