"""heronlake: retrieval, corpus-quality and RAG-evaluation analytics on Spark DataFrames."""
