"""Adoption panel: first sightings of terms by domain with left-censoring, and adoption counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C


def eligible(domain: Column, provider: Column, types: Column, sector: Column, *, social: list[str], allowed: list[str]) -> tuple[Column, Column]:
    """(domain, reason against) of a directory row; one of the two is null. The ladder ends at the first reason."""
    kinds, low = F.lower(F.coalesce(types, F.lit(""))), F.lower(sector)
    has = lambda text, words: F.greatest(*(text.contains(w) for w in words), F.lit(False))
    reason = (
        F.when(domain.isNull(), "no usable website")
        .when(F.coalesce(provider.rlike(r"\bNHS\b"), F.lit(False)), "NHS provider")
        .when(has(kinds, social), "social care")
        .when(low.isNull() | (low == ""), "not in the register")
        .when(~has(low, allowed), F.concat(F.lit("sector: "), low))
    )
    return F.when(reason.isNull(), domain), reason


def observations(seen: DataFrame) -> DataFrame:
    """seen (domain, term, month) to (domain, term, first, censored): what shows within the grace months of a domain's first capture was there before."""
    start = seen.groupBy("domain").agg(F.min("month").alias("start"))
    first = seen.groupBy("domain", "term").agg(F.min("month").alias("first"))
    return first.join(start, "domain").select("domain", "term", "first", (F.col("first") <= F.add_months("start", C.PANEL_GRACE_MONTHS)).alias("censored"))


def adoption(obs: DataFrame, anchor) -> DataFrame:
    """By term: adopters now, a year ago, the newly added of both years, acceleration and how many are censored."""
    by = lambda k: F.count_if(F.col("censored") | (F.col("first") <= F.add_months(anchor, -k)))
    sums = obs.groupBy("term").agg(F.count(F.lit(1)).alias("now"), by(12).alias("prior"), by(24).alias("base2"), F.count_if("censored").alias("censored"), F.min(F.when(~F.col("censored"), F.col("first"))).alias("first_seen"))
    out = sums.withColumns({"new_12m": F.col("now") - F.col("prior"), "new_prev_12m": F.col("prior") - F.col("base2")})
    return out.withColumn("accel", F.col("new_12m") - F.col("new_prev_12m")).withColumn("growth", F.when(F.col("prior") > 0, F.col("new_12m") / F.col("prior")).otherwise(F.col("new_12m").cast("double")))
