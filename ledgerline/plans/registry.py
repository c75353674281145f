"""Where queries are registered under their names, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..bindings import both, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; `sql` may name domain views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql)
        return f

    return register


def same_sql(name: str, body: str, duck_body: str | None = None) -> None:
    """A query that is best said in SQL; both engines run it."""
    QUERIES[name] = lambda spark, sf_dir: both(spark, sf_dir, body)
    ORACLE[name] = duck(duck_body or body)
