"""rippletrace: change-impact analytics on Spark DataFrames."""
