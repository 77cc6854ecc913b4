"""Sinks: state tables, call lists, rows as JSON, and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, *, partition: str | None = None) -> None:
    """Replace a state table; the committer makes it whole or leaves the old one's files until the job is done."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def advance(df: DataFrame, path: str, send) -> None:
    """Send a report, and only if that succeeded make df the state that the next one is held against."""
    send()
    save(df, path)


def append_missing(df: DataFrame, path: str, partition: str, have: DataFrame | None) -> DataFrame:
    """Write only the partitions that are not there yet, which then never change; the new rows."""
    fresh = df if have is None else df.join(have.select(partition).distinct(), partition, "left_anti")
    fresh.write.mode("append").partitionBy(partition).parquet(path)
    return fresh


def call_list(df: DataFrame, path: str) -> None:
    """CSV with a header; cells that a spreadsheet would run are quoted with an apostrophe."""
    kinds = dict(df.dtypes)
    safe = lambda c: F.when(F.col(c).rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) if kinds[c] == "string" else F.col(c)
    df.select(*(safe(c).alias(c) for c in df.columns)).write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON objects with their keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def markdown(df: DataFrame, title: str) -> DataFrame:
    """Lines of a Markdown table, in the order of df (a report's few rows)."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    rows = df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return df.sparkSession.createDataFrame([(x,) for x in head], "line string").unionByName(rows)
