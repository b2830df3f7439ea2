"""Analytics of repeated aerial canopy surveys as Spark DataFrames."""
