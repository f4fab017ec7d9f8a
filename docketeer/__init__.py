"""Document analytics on Spark: retrieval, chunking, text cleaning, grounding and state queries as DataFrame plans."""
