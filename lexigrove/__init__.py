"""lexigrove: corpus, inverted-index and hierarchy queries on Spark DataFrames."""
