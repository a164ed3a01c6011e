"""Incremental maintenance over file and event streams."""
