"""Growth of counts in windows of months before an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats


def in_months(day: Column, anchor: Column, back_from: int, back_to: int) -> Column:
    """Whether a day lies in (anchor - back_from months, anchor - back_to months]."""
    return (day > F.add_months(anchor, -back_from)) & (day <= F.add_months(anchor, -back_to))


def window_counts(rows: DataFrame, key: str, day: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows by key in each span of months before the newest day: one pass, whatever the number of spans.

    The newest day is one value, which a scalar subquery of a single partial maximum supplies.
    """
    anchor = rows.agg(F.max(day).alias("anchor"))
    dated = rows.select(key, day).crossJoin(F.broadcast(anchor))
    return dated.groupBy(key).agg(*(F.count_if(in_months(F.col(day), F.col("anchor"), *span)).alias(name) for name, span in spans.items()))


def weighted_growth(rows: DataFrame, key: str, latest: str = "latest", growth: str = "g12") -> DataFrame:
    """Mean growth by key, weighted by max(latest or 1, 1); rows without growth have no vote."""
    weight = F.greatest(F.coalesce(stats.number(latest), F.lit(1.0)), F.lit(1.0))
    known = rows.where(F.col(growth).isNotNull())
    return known.groupBy(key).agg((F.sum(weight * F.col(growth)) / F.sum(weight)).alias("weighted"), F.count(F.lit(1)).alias("items"))


def recovered_base(latest: str = "latest", growth: str = "g12") -> Column:
    """The count a year ago that latest and growth imply; null if growth is null or -100 %, or the base negative."""
    factor = 1 + F.col(growth) / 100
    base = F.when(factor != 0, stats.number(latest) / factor)
    return F.when(base >= 0, base)


def pooled_growth(rows: DataFrame, key: str, latest: str = "latest", growth: str = "g12") -> DataFrame:
    """Growth of summed counts by key over their summed recovered bases."""
    base = recovered_base(latest, growth)
    sums = rows.groupBy(key).agg(F.sum(F.when(base.isNotNull(), stats.number(latest))).alias("latest"), F.sum(base).alias("base"), F.count(F.lit(1)).alias("items"))
    return sums.withColumn("pooled", F.when(F.col("base") > 0, (F.col("latest") / F.col("base") - 1) * 100))
