"""lexaspark: full-text retrieval, ranking and corpus operators on Spark DataFrames."""
