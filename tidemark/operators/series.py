"""Monthly series: rolling windows, lagged medians, robust scores and boom onsets, all series of a table at once.

A series table has the columns series, t (0, 1, ...), month and v, dense in t.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C


def line(by: str = "series") -> Window:
    return Window.partitionBy(by).orderBy("t")


def rows(back: int, to: int = 0, by: str = "series") -> Window:
    """The frame from `back` rows before to `to` rows before (negative: after)."""
    return line(by).rowsBetween(-back, -to)


def rolling_sum(v: str = "v", w: int = 12) -> Column:
    """Sum of the last w values; null for the first w - 1."""
    return F.when(F.col("t") >= w - 1, F.sum(v).over(rows(w - 1)))


def trimmed_sum(v: str = "v", w: int = 12) -> Column:
    """The same without the window's largest value."""
    return F.when(F.col("t") >= w - 1, F.sum(v).over(rows(w - 1)) - F.max(v).over(rows(w - 1)))


def lagged_median(r: str, low: int = 24, high: int = 12, least: int = 7) -> Column:
    """Median of the values low to high rows before; null if fewer than `least` are known."""
    frame = rows(low, high)
    return F.when(F.count(r).over(frame) >= least, F.expr(f"percentile({r}, 0.5)").over(frame))


def _middle(xs: Column, n: int) -> Column:
    """Median of an array of n sorted values."""
    return (F.get(xs, F.lit((n - 1) // 2)) + F.get(xs, F.lit(n // 2))) / 2


def robust_z(z0: str, n: int = C.BASELINE_N) -> Column:
    """Distance from the median of the n values before, in robust standard deviations of at least 1; needs all n."""
    before = F.collect_list(z0).over(rows(n, 1))
    med = _middle(F.array_sort(before), n)
    spread = 1.4826 * _middle(F.array_sort(F.transform(before, lambda x: F.abs(x - med))), n)
    return F.when(F.col(z0).isNotNull() & (F.size(before) >= n), (F.col(z0) - med) / F.greatest(F.greatest(spread, F.lit(1.0)), F.lit(C.MIN_SD)))


def growth_scores(series: DataFrame) -> DataFrame:
    """Adds r, rt (12-sums, whole and trimmed), b (baseline), g, gt (log growth), se and z."""
    out = series.withColumns({"r": rolling_sum(), "rt": trimmed_sum()})
    out = out.withColumns({"b": lagged_median("r"), "bt": lagged_median("rt")})
    k, known = C.K_SMOOTH, F.col("b").isNotNull() & F.col("bt").isNotNull() & F.col("r").isNotNull()
    out = out.withColumns({
        "g": F.when(known, F.ln((F.col("r") + k) / (F.col("b") + k))),
        "se": F.when(known, F.sqrt(1 / (F.col("r") + k) + 1 / (F.col("b") + k))),
        "gt": F.when(known, F.ln((F.col("rt") + k) / (F.col("bt") + k))),
    })
    return out.withColumn("z0", F.col("g") / F.col("se")).withColumn("z", robust_z("z0"))


def onsets(series: DataFrame, *, min_level: float | Column = 0.0, growth_x: float = C.GROWTH_X) -> DataFrame:
    """One row a series: the first month of a boom that is large, not one freak month, unlikely, of some level and lasting; null if none."""
    scored = growth_scores(series)
    after = rows(-1, -C.SUSTAIN_MONTHS)
    lasting = (F.count("z").over(after) == C.SUSTAIN_MONTHS) & (F.min("z").over(after) >= C.Z_SUSTAIN)
    boom = (F.col("g") >= math.log(growth_x)) & (F.col("gt") >= math.log(1 + (growth_x - 1) * C.TRIM_FRAC)) & (F.col("z") >= C.Z_TRIGGER) & (F.col("r") >= min_level) & lasting
    hit = scored.withColumn("hit", F.coalesce(boom, F.lit(False)))
    first = F.min(F.when(F.col("hit"), F.struct("t", "month", "z", "g", "b", "r")))
    found = hit.groupBy("series").agg(first.alias("first"), F.max("z").alias("peak_z"), F.count("z").alias("testable"), F.max(F.struct("t", "r")).alias("last"), F.sum("v").alias("total"))
    return found.select(
        "series", F.col("first.month").alias("onset"), F.col("first.t").alias("onset_t"), F.col("first.z").alias("z_at_onset"), (F.exp("first.g") - 1).alias("growth_at_onset"), F.col("first.b").alias("baseline_at_onset"),
        F.col("first.r").alias("level_at_onset"), (F.col("first.b") < C.LOW_COUNT).alias("low_count_unreliable"), "peak_z", "testable", F.col("last.r").alias("latest_12m"), "total",
    )


def plain_onsets(series: DataFrame) -> DataFrame:
    """The plain estimator: year-on-year ratio, mean and deviation of the 24 known values before, two months of persistence."""
    before = F.lag("v", 12).over(line())
    out = series.withColumn("undefined", (F.col("t") >= 12) & (before == 0)).withColumn("g", F.when(before != 0, F.col("v") / before - 1))
    frame = rows(C.BASELINE_N, 1)
    sd = F.stddev_pop("g").over(frame)
    out = out.withColumn("z", F.when(F.col("g").isNotNull() & (F.count("g").over(frame) >= C.BASELINE_N) & (sd > 0), (F.col("g") - F.avg("g").over(frame)) / sd))
    after = rows(-1, -2)
    out = out.withColumn("hit", F.coalesce((F.col("z") >= 2.0) & (F.count("z").over(after) == 2) & (F.min("z").over(after) >= 1.0), F.lit(False)))
    return out.groupBy("series").agg(F.min(F.when(F.col("hit"), F.col("t"))).alias("onset_t"), F.count_if("undefined").alias("undefined"), F.count("z").alias("testable"))


def dense(counts: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """Counts by key and month as series over the whole span of months, 0 where nothing was counted."""
    span = counts.agg(F.min(month).alias("a"), F.max(month).alias("b")).select(F.posexplode(F.expr("sequence(a, b, interval 1 month)")).alias("t", "month"))
    axis = counts.select(F.col(key).alias("series")).distinct().crossJoin(F.broadcast(span))
    known = counts.select(F.col(key).alias("series"), F.col(month).alias("month"), F.col(value).cast("double").alias("v"))
    return axis.join(known, ["series", "month"], "left").select("series", "t", "month", F.coalesce("v", F.lit(0.0)).alias("v"))
