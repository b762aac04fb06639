"""termloom: content analytics and recommendation on Spark DataFrames."""
