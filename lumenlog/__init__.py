"""lumenlog: access-log analytics on Spark DataFrames."""
