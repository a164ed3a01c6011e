"""Graph, search, similarity and maintenance operators over node and edge tables."""
