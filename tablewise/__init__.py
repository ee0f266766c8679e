"""tablewise: data quality and table analytics on Spark DataFrames."""
