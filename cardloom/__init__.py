"""Model-catalog analytics and text-corpus operators on Spark DataFrames."""
