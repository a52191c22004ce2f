"""Customer churn features and scores, computed with Spark DataFrames."""
