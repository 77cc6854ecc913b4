"""State between runs: what is fetched again, what was last sent, growth from the own trail, and work dealt to workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats


def refetch(sweeps: DataFrame, wanted: int = 2) -> DataFrame:
    """sweeps (key, sweep, complete) to (key, run, refetch): run is the number of complete sweeps since the last incomplete one."""
    bad = F.max(F.when(~F.col("complete"), F.col("sweep"))).over(Window.partitionBy("key"))
    since = sweeps.withColumn("bad", bad).withColumn("good", F.col("bad").isNull() | (F.col("sweep") > F.col("bad")))
    runs = since.groupBy("key").agg(F.count_if("good").alias("run"))
    newest = F.broadcast(runs.agg(F.max("key").alias("newest")))
    return runs.crossJoin(newest).select("key", "run", ((F.col("run") == 0) | ((F.col("key") == F.col("newest")) & (F.col("run") < wanted))).alias("refetch"))


def last_sent(reports: DataFrame, by: str, day: str) -> DataFrame:
    """reports with sent: adds baseline, the day of the last report before it that went out; a failed one moves nothing."""
    line = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return reports.withColumn("baseline", F.max(F.when(F.col("sent"), F.col(day))).over(line))


def trail_growth(trail: DataFrame, key: str, month: str, value: str, months: int) -> DataFrame:
    """(key, now, was, base, growth): the newest point against the newest that is so many months older."""
    newest = F.broadcast(trail.agg(F.max(month).alias("__now")))
    old = F.when(F.col(month) <= F.add_months("__now", -months), F.struct(F.col(month).alias("m"), F.col(value).alias("v")))
    sums = trail.crossJoin(newest).groupBy(key).agg(F.max(F.when(F.col(month) == F.col("__now"), F.col(value))).alias("now"), F.max(old).alias("b"))
    return sums.where("now is not null").select(key, "now", F.col("b.v").alias("was"), F.col("b.m").alias("base")).withColumn("growth", stats.growth_pct("now", "was"))


def deal(cells: DataFrame, have: DataFrame, keys: list[str], worker: Column, order: list[Column], budget: int) -> DataFrame:
    """Cells that are not there yet, dealt to workers; of each worker the first `budget` in order, which a deadline allows."""
    todo = cells.join(have, keys, "left_anti").withColumn("worker", worker)
    return todo.withColumn("place", F.row_number().over(Window.partitionBy("worker").orderBy(*order))).where(F.col("place") <= budget)
