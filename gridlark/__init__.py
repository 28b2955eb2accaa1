"""Entity-year panels, typed yearly graphs and exact ranking metrics on Spark DataFrames."""
