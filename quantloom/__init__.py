"""Analytics engine for daily equity research on Spark DataFrames."""
