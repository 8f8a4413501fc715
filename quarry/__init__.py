"""Text exploration and retrieval on Spark DataFrames."""
