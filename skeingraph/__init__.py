"""Skeingraph: call-graph analytics on Spark DataFrames."""
