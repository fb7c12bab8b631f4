"""A registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import sql

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
        """Register a function under its name; ``oracle`` follows the common table expressions ``views``.  Without one SQL cannot say it."""

        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracle[f.__name__] = sql(oracle, *views)
            return f

        return register
