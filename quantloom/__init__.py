"""Panel factor jobs on Spark DataFrames."""
