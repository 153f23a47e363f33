"""Training and health analytics on Spark: DataFrames in, DataFrames out."""
