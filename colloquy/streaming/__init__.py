"""Streaming forms of batch operators, an addition for live input."""
