"""Operators for preparing training text at scale.

One module per operator.  Nothing outside this package imports it; the registered queries are in ``queries.py``.
"""
