"""thicket: document ingestion and retrieval on Spark DataFrames."""
