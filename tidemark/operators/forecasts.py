"""Calls, the sightings that bear them out, and their grades by a rule that is fixed when a call is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import joins

TIERS = 4


def sightings(calls: DataFrame, snapshots: DataFrame, by: list[str]) -> DataFrame:
    """(call, first, second, late) of each call (call, *by, at, matures, base) with a snapshot (*by, day, fired) of more tiers than base.

    first and second are days up to maturity, the second at least CONFIRM_GAP_DAYS after the first; late is the first day after maturity
    and within the window of the snapshot that grades. Calls on all tiers have nothing left to show and are not looked up.
    """
    spans = calls.where(F.col("base") < TIERS).select("call", *by, "at", "matures", "base", F.date_add("matures", C.MATURITY_WINDOW_DAYS).alias("until"))
    seen = joins.in_interval(snapshots, spans, by, "day", "at", "until", C.HORIZON_DAYS + C.MATURITY_WINDOW_DAYS).where("fired > base")
    early = F.when(F.col("day") <= F.col("matures"), F.col("day"))
    marked = seen.select("call", "day", early.alias("early")).withColumn("first", F.min("early").over(Window.partitionBy("call")))
    confirms = F.col("early") >= F.date_add("first", C.CONFIRM_GAP_DAYS)
    return marked.groupBy("call").agg(F.first("first").alias("first"), F.min(F.when(confirms, F.col("early"))).alias("second"), F.min(F.when(F.col("early").isNull(), F.col("day"))).alias("late"))


def watches(seen: DataFrame) -> DataFrame:
    """(call, nth, day): the records of a call's first sighting and of the one that confirms it."""
    both = F.array(*(F.struct(F.lit(n).alias("nth"), F.col(c).alias("day")) for n, c in ((1, "first"), (2, "second"))))
    return seen.select("call", F.explode(both).alias("x")).select("call", "x.nth", "x.day").where("day is not null")


def grade(calls: DataFrame, snapshots: DataFrame, by: list[str]) -> DataFrame:
    """(call, *by, at, base, snapshot, outcome, evidence, lead_days) of matured calls.

    A hit is confirmed by two sightings or fires on more tiers at the snapshot nearest to maturity; where there is neither that snapshot
    nor a confirmation, or no tier was left, the call is ungradeable and leaves the score.
    """
    near = joins.nearest(calls, snapshots.select(*by, F.col("day").alias("matures"), "fired"), by, "matures", "fired", F.lit(C.MATURITY_WINDOW_DAYS))
    facts = near.join(sightings(calls, snapshots, by), "call", "left")
    confirmed = F.col("second").isNotNull()
    dark = (F.col("base") >= TIERS) | (F.col("near_at").isNull() & ~confirmed)
    outcome = F.when(dark, "ungradeable").when(confirmed | F.coalesce(F.col("near_value") > F.col("base"), F.lit(False)), "hit").otherwise("miss")
    graded = facts.withColumn("outcome", outcome).withColumn("evidence", F.when(F.col("outcome") == "hit", F.coalesce("first", "late")))
    return graded.select("call", *by, "at", "base", F.col("near_at").alias("snapshot"), "outcome", "evidence", F.datediff("evidence", "at").alias("lead_days"))
