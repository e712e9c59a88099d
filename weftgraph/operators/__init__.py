"""Graph operators: retrieval, traversal, document queries, writes."""
