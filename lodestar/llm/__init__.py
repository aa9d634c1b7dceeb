"""Training-data operators over Spark DataFrames.  Nothing outside this package imports it."""
