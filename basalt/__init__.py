"""Analytics over collected web assets, as Spark DataFrames."""
