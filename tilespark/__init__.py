"""Dense and block-sparse linear algebra on Spark DataFrames."""
