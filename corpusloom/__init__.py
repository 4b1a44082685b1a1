"""corpusloom: document ingestion, retrieval, graph and maintenance operators on Spark DataFrames."""
