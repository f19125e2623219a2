"""Clinical-trial analytics on Spark DataFrames."""
