"""Code-graph, retrieval, message-stream and text-edit analytics on Spark DataFrames."""
