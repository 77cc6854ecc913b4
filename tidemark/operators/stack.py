"""The stack: how far each niche has travelled through the tiers, what crossed the line since the baseline, and what is still early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import stats
from tidemark.operators import growth


def stage(t0: Column, t1: Column, demand: Column, f: dict[str, Column]) -> Column:
    """The latest firing tier says how far it has travelled."""
    early = f["t1"] | f["t2"]
    lit_any = early | f["t3"] | f["t4"]
    base = (
        F.when(~lit_any, F.when(F.col("t1").isNotNull() | F.col("t2").isNotNull() | F.col("t3").isNotNull(), "quiet").otherwise("nodata"))
        .when(f["t4"], F.when(early, "mainstream").otherwise("cooling"))
        .when(f["t3"], F.when(early, "building").otherwise("cooling"))
        .when(f["t2"], "emerging")
        .otherwise("early")
    )
    return F.when((demand == "falling") & ~early, "cooling").otherwise(base)


def demand(t0: Column, t1: Column, f0: Column, f1: Column) -> Column:
    """What the tiers of demand that fire say; if none does, search and then waits."""
    best = F.greatest(F.when(f0, t0), F.when(f1, t1))
    quiet = F.coalesce(t1, t0)
    return F.when(best >= C.BOOM, "booming").when(best.isNotNull(), "growing").when(quiet.isNull(), "unknown").when(quiet <= C.FALLING, "falling").otherwise("flat")


def build(rows: DataFrame) -> DataFrame:
    """rows (tier t0..t4, niche, latest, g12) to one row a niche: its growth by tier, stage and rank. t1 is an index."""
    keyed = rows.withColumn("key", F.struct("tier", "niche"))
    pooled = growth.pooled_growth(keyed, "key").select("key.tier", "key.niche", "pooled", F.round("base").alias("base"))
    tiers = ("t0", *C.TIERS)
    wide = pooled.groupBy("niche").agg(*(F.max(F.when(F.col("tier") == t, F.col(c))).alias(t if c == "pooled" else f"b_{t}") for t in tiers for c in ("pooled", "base")))
    f = {t: stats.fires(t, f"b_{t}", F.lit(t == "t1")) for t in tiers}
    read = demand(F.col("t0"), F.col("t1"), f["t0"], f["t1"])
    named = wide.withColumn("demand", read).withColumn("stage", stage(F.col("t0"), F.col("t1"), F.col("demand"), f))
    rank = F.create_map(*(F.lit(x) for pair in C.STAGE_RANK.items() for x in pair))[F.col("stage")]
    return named.withColumn("rank", rank)


def order() -> list[Column]:
    """Earliest stage first, then by how hard search and then new companies move."""
    return [F.col("rank").desc(), F.col("t1").desc_nulls_last(), F.col("t2").desc_nulls_last(), F.col("niche")]


def crossings(now: DataFrame, prev: DataFrame, floor: float) -> DataFrame:
    """(key, now, weight) against (key, was): what crossed the line, and what is kept from counting as that."""
    both = now.join(prev, "key", "full")
    a, b, line, margin = F.col("was"), F.col("now"), C.RISING, C.MARGIN
    thin = F.coalesce(F.col("weight"), F.lit(0.0)) < floor
    near = (F.abs(b - line) < margin) | (F.abs(a - line) < margin)
    move = (
        F.when(b.isNull(), F.when(a >= line, "dropped out"))
        .when(a.isNull(), F.when(b < line, F.lit(None)).when(thin, "new but thin").when(b < line + margin, "new in noise band").otherwise("new"))
        .when((a >= line) == (b >= line), F.lit(None))
        .when(thin, "crossed but thin")
        .when(near, "wobble")
        .when(b >= line, "up")
        .otherwise("down")
    )
    return both.select("key", "was", "now", move.alias("move"))


def watchlist(now: DataFrame, floors: dict[str, float] = C.MIN_WEIGHT) -> DataFrame:
    """(niche, t1, t2, t3, w1, w2): leading tiers lit and not thin, the lagging one not; absent is not the same as flat."""
    is_lit = lambda t, w: F.coalesce(F.col(t) >= C.RISING, F.lit(False)) & (F.coalesce(F.col(w), F.lit(0.0)) >= floors[t])
    lit1, lit2 = is_lit("t1", "w1"), is_lit("t2", "w2")
    return now.where((lit1 | lit2) & ~F.coalesce(F.col("t3") >= C.RISING, F.lit(False))).select("niche", (lit1.cast("int") + lit2.cast("int")).alias("lit"), "t1", "t2", "t3", F.col("t3").isNull().alias("t3_absent"))


# How a report shows states without an onset.
SHOWN = {"NO_ONSET": "no onset", "ALREADY_BOOMING": "_abstains: already booming_", "OUT_OF_SCOPE": "_abstains: out of scope_", "BELOW_FLOOR": "_abstains: below floor_", "NO_DATA": "_no data_"}


def cell(state: Column, onset: Column) -> Column:
    """The text of a tier's state: the onset in bold, or why there is none."""
    other = F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))[state]
    return F.when(state == "FIRED", F.concat(F.lit("**"), onset.cast("string"), F.lit("**"))).otherwise(F.coalesce(other, state))
