"""Network-quality and outage analytics on Spark's DataFrames."""
