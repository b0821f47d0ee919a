"""Usage analytics for AI command-line tools as Spark DataFrames."""
