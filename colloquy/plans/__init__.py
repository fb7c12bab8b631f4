"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from . import analytics_queries, array_queries, evaluation_queries, interval_queries, metric_queries, text_queries

_MODULES = (interval_queries, analytics_queries, array_queries, text_queries, metric_queries, evaluation_queries)


def all_queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: s for m in _MODULES for name, s in m.ORACLE_SQL.items()}
