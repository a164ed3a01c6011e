"""The graph query language: text to tokens to a tree to a DataFrame."""
