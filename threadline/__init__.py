"""Event-sequence analytics and corpus preparation on Spark DataFrames."""
