"""Incremental personalized PageRank over sliding windows of edge streams, on Spark DataFrames."""
