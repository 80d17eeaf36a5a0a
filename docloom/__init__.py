"""docloom: document analytics and retrieval on Spark DataFrames."""
