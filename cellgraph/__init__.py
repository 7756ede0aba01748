"""Points-to and memory-graph analytics on Spark DataFrames."""
