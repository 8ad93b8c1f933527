"""Vehicle-trajectory analytics on Spark DataFrames."""
