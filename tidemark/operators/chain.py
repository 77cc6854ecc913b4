"""An append-only log whose entries are chained by hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import places

GENESIS = "0" * 64


def append(bodies: DataFrame, order: str, body: str, last: str = GENESIS) -> DataFrame:
    """(order, body, prev_hash, hash) of new entries behind a log that ends with the hash last.

    Hashing is sequential by nature, and a run appends a handful of entries: they are folded in one array.
    """
    rows = bodies.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(body).alias("body")))).alias("all"))
    start = F.array(F.struct(F.lit(None).cast(bodies.schema[order].dataType).alias("k"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("prev"), F.lit(last).alias("hash")))

    def step(done, x):
        prev = F.element_at(done, -1)["hash"]
        return F.concat(done, F.array(F.struct(x["k"].alias("k"), x["body"].alias("body"), prev.alias("prev"), F.sha2(F.concat(prev, x["body"]), 256).alias("hash"))))

    folded = rows.select(F.aggregate("all", start, step).alias("all"))
    chained = folded.select(F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("x"))
    return chained.select(F.col("x.k").alias(order), F.col("x.body").alias("body"), F.col("x.prev").alias("prev_hash"), F.col("x.hash").alias("hash"))


def verify(log: DataFrame, order: str) -> DataFrame:
    """Adds ok: whether an entry's hash is that of its body and the one before it. Entries meet the one before by a join on places."""
    placed = places(log, order, [], name="__place")
    last = placed.select((F.col("__place") + 1).alias("__place"), F.col("hash").alias("__before"))
    before = F.coalesce("__before", F.lit(GENESIS))
    ok = (F.col("prev_hash") == before) & (F.col("hash") == F.sha2(F.concat("prev_hash", "body"), 256))
    return placed.join(last, "__place", "left").select(*log.columns, ok.alias("ok"))
