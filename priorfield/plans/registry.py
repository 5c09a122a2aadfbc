"""Named queries with the SQL another engine can run for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .orders import ENTRIES_SQL, EVENTS_SQL, OrderTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = "entries"):
    """Register a query. ``base`` says which common table expressions go before the SQL."""
    def add(build):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, folder: build(OrderTables(spark, folder))
        if sql is not None:
            start = "WITH RECURSIVE" if "UNION ALL" in sql else "WITH"
            head = {"entries": f"{start} {ENTRIES_SQL}", "events": f"{start} {EVENTS_SQL}", "": ""}[base]
            body = sql.strip()
            if head and body.startswith(","):
                ORACLE[name] = head + body
            else:
                ORACLE[name] = f"{head} {body}".strip()
        return build

    return add
