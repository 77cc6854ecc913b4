"""Joins in time: as-of, nearest and interval joins by key, without all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], *, prefix: str = "asof_") -> DataFrame:
    """left with the values of right's newest row at or before left's time; null where there is none.

    Both sides are put in one line by key and time and the last value is carried on: one sort, no pairs. Rows of right that
    share key and time count as one, the largest.
    """
    r = right.groupBy(*by, at).agg(F.max(F.struct(*values)).alias("__r"))
    both = left.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).withColumn("__left", F.lit(1)).unionByName(r.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    line = Window.partitionBy(*by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__r", ignorenulls=True).over(line)).where("__left = 1")
    return carried.select(*left.columns, *(F.col(f"__last.{v}").alias(prefix + v) for v in values))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tolerance: Column) -> DataFrame:
    """left with right's nearest row in time, not farther than the tolerance; of two as near, the earlier.

    The row before and the row after are carried along one line by key and time.
    """
    r = right.groupBy(*by, at).agg(F.max(value).alias("__v")).withColumn("__r", F.struct(F.col(at).alias("t"), F.col("__v").alias("v"))).drop("__v")
    both = left.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).withColumn("__left", F.lit(1)).unionByName(r.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    line = Window.partitionBy(*by).orderBy(at, "__left")
    before = F.last("__r", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__r", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    gap = lambda c: F.abs(F.datediff(F.col(f"{c}.t"), F.col(at)))
    near = both.withColumns({"__b": before, "__a": after}).where("__left = 1").withColumns({"__gb": gap("__b"), "__ga": gap("__a")})
    pick = F.when(F.col("__b").isNotNull() & (F.col("__ga").isNull() | (F.col("__gb") <= F.col("__ga"))), F.col("__b")).otherwise(F.col("__a"))
    near = near.withColumn("__p", pick).withColumn("__ok", F.least("__gb", "__ga") <= tolerance)
    return near.select(*left.columns, F.when(F.col("__ok"), F.col("__p.t")).alias("near_at"), F.when(F.col("__ok"), F.col("__p.v")).alias("near_value"))


def in_interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width_days: int) -> DataFrame:
    """Points with the spans (start, end] of their key that hold them, joined on key and a cell of width_days.

    A span is copied to the cells it touches, so that the join is on equality and a key's points and spans never meet all with all.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    cell = lambda c: F.floor(day(c) / width_days)
    wide = spans.withColumn("__cell", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("__cell", cell(at)).join(wide, [*by, "__cell"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("__cell")
