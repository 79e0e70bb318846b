"""Field-treatment analytics on Spark DataFrames."""
