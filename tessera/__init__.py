"""tessera: evaluation analytics on Spark DataFrames."""
