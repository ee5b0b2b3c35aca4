"""Evidence retrieval, answer evaluation and training-data operators on Spark DataFrames."""
