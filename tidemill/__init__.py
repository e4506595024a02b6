"""tidemill: corpus building, retrieval scoring and message handling on Spark DataFrames."""
