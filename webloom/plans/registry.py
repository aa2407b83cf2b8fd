"""All queries of the library proper, each with SQL for a second engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a function under its name, with SQL that gives the same rows."""

    def enter(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return enter


from webloom.plans import history_queries, markup_queries, page_queries, score_queries, site_queries, store_queries  # noqa: E402, F401
