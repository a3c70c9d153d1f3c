"""orderstream: order analytics expressed as Spark DataFrames, in batch and in Structured Streaming."""
