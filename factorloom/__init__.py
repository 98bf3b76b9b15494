"""factorloom: cross-sectional factor analytics on Spark DataFrames."""
