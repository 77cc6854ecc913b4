"""Sources that were fetched and landed as files: JSON payloads, CSV extracts and sitemaps."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import Scratch
from tidemark.shipping import ship

RISING = "struct<related_queries: struct<rising: array<struct<query: string, value: string, extracted_value: double>>>>"
RECORDS = "struct<success: boolean, result: struct<result: struct<records: array<map<string,string>>>>>"


def rising_queries(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each rising query of a payload; a payload that doesn't parse gives none."""
    parsed = payloads.withColumn("__p", F.from_json(column, RISING))
    return parsed.select(*payloads.columns, F.explode("__p.related_queries.rising").alias("q")).select(*payloads.columns, F.col("q.query"), F.col("q.value").alias("label"), F.col("q.extracted_value"))


def code_records(payloads: DataFrame, code: str, value: str, column: str = "payload") -> DataFrame:
    """(code, items) of a landed aggregate; null sums stay null, so that a wrong column can't pass for zeros."""
    parsed = payloads.withColumn("__p", F.from_json(column, RECORDS))
    return parsed.select(F.explode("__p.result.result.records").alias("r")).select(F.col("r")[code].alias("code"), F.col("r")[value].try_cast("double").alias("items"))


def count(text: Column) -> Column:
    """A count from a CSV cell: thousands commas are dropped; blank or bad cells are 0, as the publisher means them."""
    return F.coalesce(F.regexp_replace(F.trim(text), ",", "").try_cast("double"), F.lit(0.0)).cast("long")


def waiting_times(spark: SparkSession, path: str | list[str], by: Column | None = None) -> DataFrame:
    """Monthly extracts by specialty (and by what else is given): pathways in total, over 18 and over 52 weeks, resolved by header."""
    raw = spark.read.csv(path, header=True)
    raw = raw if by is None else raw.withColumn("by", by)
    weeks = sorted((int(c.split("Gt ")[1].split(" ")[0]), c) for c in raw.columns if c.startswith("Gt ") and "Weeks SUM" in c)
    total = lambda least: sum((count(F.col(f"`{c}`")) for w, c in weeks if w >= least), F.lit(0).cast("long"))
    kept = raw.where(~F.coalesce(F.col("`Commissioner Org Code`") == "NONC", F.lit(False)) & F.col("`RTT Part Type`").startswith("Part_2"))
    keys = [F.trim("`Treatment Function Name`").alias("specialty"), *(["by"] if by is not None else [])]
    return kept.groupBy(*keys).agg(F.sum(count(F.col("`Total All`"))).alias("total"), F.sum(total(18)).alias("over_18"), F.sum(total(52)).alias("over_52"))


def newest_per_month(index: DataFrame) -> DataFrame:
    """index (month, url): the newest file of each month; a revised one wins."""
    revised = F.lower("url").contains("revised")
    return index.groupBy("month").agg(F.max_by("url", F.struct(revised.alias("r"), F.length("url").alias("l"), "url")).alias("url"))


def sitemap_urls(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Distinct locations of sitemaps."""
    return documents.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()


def compressed(documents: DataFrame, where: Column) -> DataFrame:
    """(url, xml) to (url, content), gzip where that holds: for fixtures."""

    @F.pandas_udf("binary")
    def pack(xml: pd.Series, zipped: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(x.encode()) if z else x.encode() for x, z in zip(xml, zipped)])

    return documents.select("url", pack("xml", where).alias("content"))


def sitemap_crawl(landed: DataFrame, start: str, most: int = 10) -> DataFrame:
    """landed (url, content), plain or gzip, to the distinct page locations that a sitemap index leads to, level by level."""

    @F.pandas_udf("string")
    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace") if b is not None else None)

    ship(landed.sparkSession)
    scratch = Scratch(landed.sparkSession, "sitemaps")
    read = scratch.keep(landed.select("url", plain("content").alias("xml")))
    located = read.select(F.col("url").alias("map"), F.col("xml").contains("<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))
    located, found = scratch.keep(located), None
    todo = scratch.keep(landed.sparkSession.createDataFrame([(start,)], "map string"))
    seen = todo
    for _ in range(most):
        level = located.join(todo, "map", "left_semi")
        pages = level.where("not is_index").select(F.col("loc").alias("url"))
        found = pages if found is None else found.union(pages)
        todo = scratch.keep(level.where("is_index").select(F.col("loc").alias("map")).distinct().join(seen, "map", "left_anti"))
        if todo.isEmpty():
            break
        seen = seen.union(todo)
    return scratch.finish(found.distinct())


MONTHS = "map<string, struct<counts: map<string, bigint>>>"


def month_counts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(month, code, items) of history kept as maps of months to maps of codes."""
    months = payloads.select(F.explode(F.from_json(column, MONTHS)).alias("month", "of"))
    return months.select("month", F.explode("of.counts").alias("code", "items"))
