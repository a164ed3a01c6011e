"""Readers that turn tables, files and text formats into node, edge and record tables."""
