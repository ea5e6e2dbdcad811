"""Document analytics and retrieval on Spark: DataFrame transforms over named tables."""
