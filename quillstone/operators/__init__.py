"""Relational operators over documents, nodes, annotations and edges."""
