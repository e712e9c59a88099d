"""The fixture graph, the queries on it, and their SQL."""
