"""Formats to write: each turns rows into lines or documents, which Spark's own writers put into files."""
