"""Binary-asset analytics on Spark DataFrames."""
