"""What a module of queries starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    """Queries and oracles by name, and the decorator that adds a query with its SQL, if there is any."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
