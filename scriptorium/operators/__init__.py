"""DataFrame operators: chunking, retrieval, evaluation, works, assembly, operations."""
