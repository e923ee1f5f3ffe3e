"""pagewatch: web-integrity analytics on Spark DataFrames."""
