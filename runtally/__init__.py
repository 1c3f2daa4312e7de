"""Run-history analytics on Spark DataFrames."""
