"""lucidex: evidence analytics on Spark DataFrames."""
