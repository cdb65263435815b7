"""bitloom: sparse bit sets, compressed tensors and their analytics on Spark DataFrames."""
