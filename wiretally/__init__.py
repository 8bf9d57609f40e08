"""Database-traffic analytics on Spark: DataFrames in, DataFrames out."""
