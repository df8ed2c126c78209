"""Operators: relational, graph, text, semantic, temporal, paging."""
