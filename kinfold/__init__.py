"""Entity resolution and pair analytics on Spark DataFrames."""
