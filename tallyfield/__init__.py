"""Tables and streams of multi-sensor person records, as Spark DataFrames."""
