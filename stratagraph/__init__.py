"""A snapshot, graph and retrieval engine on PySpark."""
