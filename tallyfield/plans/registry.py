"""Named queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str,
    sql: str | None = None,
    views: tuple[str, ...] = (),
    ctes: str = "",
    recursive: bool = False,
) -> Callable[[Query], Query]:
    """Register a query; ``views`` and ``ctes`` are put in front of its SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql, ctes, recursive)
        return fn

    return add
