"""All queries of the engine, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = (), name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows.

    The columns days are dates, which both sides return as YYYY-MM-DD.
    """

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in days})) if days else f
        if sql:
            as_text = ", ".join(f"cast(cast({c} as date) as varchar) as {c}" for c in days)
            ORACLE_SQL[key] = f"select * replace ({as_text}) from ({sql}) as rows_" if days else sql
        return f

    return add


def load() -> None:
    """Import every module of queries."""
    from tidemark.plans import composites, flows, forecast, growth, helpers, joins, ranking, series, structure, text  # noqa: F401
