"""Named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseframe.plans.views import view_sql
from caseframe.session import pin

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``views`` are put in front of ``sql`` as common table expressions."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn

    return register


def with_views(sql: str, *names: str) -> str:
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({view_sql(n)})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def iso_sql(x: str) -> str:
    """ISO text of a timestamp with ``+00:00``."""
    micros = f"(((epoch_us({x}) % 1000000) + 1000000) % 1000000)"
    return (
        f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN '' "
        f"ELSE '.' || lpad(CAST({micros} AS VARCHAR), 6, '0') END || '+00:00'"
    )
