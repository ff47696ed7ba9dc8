"""quern: corpus analytics on Spark DataFrames."""
