"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracles, decorator): the decorator takes the oracle's SQL, or nothing."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            queries[name or f.__name__] = f
            if sql is not None:
                oracles[name or f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def r6(x: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, for comparison across engines."""
    out = F.round(F.col(x) if isinstance(x, str) else x, 6)
    return out.alias(name or x)
