"""A time-series analytics engine on Spark DataFrames."""
