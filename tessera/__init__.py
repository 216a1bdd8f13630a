"""tessera: typed models and relations compiled into lazy Spark DataFrames."""
