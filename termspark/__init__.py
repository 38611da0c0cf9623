"""A terminology engine built from Spark DataFrames."""
