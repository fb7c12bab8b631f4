"""Annotation sources: files are read by Spark, lines and documents parsed into typed rows."""
