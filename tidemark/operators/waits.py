"""Waiting times: landed monthly extracts, and the growth of what waits too long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.sources import landed


def landed_months(spark: SparkSession, newest: DataFrame) -> DataFrame:
    """newest (month, url) to (specialty, month number, total, over_18, over_52); one url a month is all that reaches the driver."""
    urls = [r["url"] for r in newest.select("url").collect()]
    rows = landed.waiting_times(spark, urls, by=F.regexp_extract(F.input_file_name(), r"m=(\d{4}-\d{2})", 1))
    return rows.withColumn("m", F.substring("by", 1, 4).cast("int") * 12 + F.substring("by", 6, 2).cast("int")).drop("by")


def growth(monthly: DataFrame, total: str) -> DataFrame:
    """One row a specialty of the newest month; latest is the count over 18 weeks, which g1, g3 and g12 are the growth of."""
    line = Window.partitionBy("specialty").orderBy("m")
    back = {f"m{k}": F.max("over_18").over(line.rangeBetween(-k, -k)) for k in (1, 3, 12)}
    newest = F.broadcast(monthly.agg(F.max("m").alias("n")))
    rows = monthly.withColumns(back).crossJoin(newest).where((F.col("m") == F.col("n")) & (F.col("total") > 0))
    is_total = F.col("specialty") == total
    change = {f"g{k}": F.round(stats.growth_pct("over_18", f"m{k}"), 6) for k in (1, 3, 12)}
    return rows.select(
        F.when(is_total, "All specialties").otherwise(F.col("specialty")).alias("name"), F.col("over_18").alias("latest"), "total", F.col("over_52").alias("over52"), stats.safe_pct(F.col("over_18"), F.col("total")).alias("pct18"),
        *(c.alias(n) for n, c in change.items()), is_total.alias("is_total"),
    )
