"""kinweave: grouping recurring entities by their vectors, on Spark DataFrames."""
