"""Multi-operator plans: extraction, chunking, indexing and the query tools."""
