"""latticeflow: probabilistic subword tokenization analytics on Spark DataFrames."""
