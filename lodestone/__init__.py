"""A library of analytic operators on Spark DataFrames."""
