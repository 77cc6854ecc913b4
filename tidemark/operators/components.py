"""Connected components of distributed edges, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of edges (u, v): the least node that can be reached. Null and looping edges are ignored.

    Every round writes its edges to the shared folder, counts and sums them in the same job, and deletes those of the round
    before; it ends when a round changes nothing. The result reads the last round's table in scratch.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    totals = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    edges, before = scratch.measure(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *totals)
    for _ in range(max_rounds if before["n"] else 0):
        last = edges
        edges, after = scratch.measure(small_star(large_star(last)), *totals)
        scratch.drop(last)
        if after == before:
            break
        before = after
    else:
        if before["n"]:
            raise RuntimeError(f"the components didn't settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def shared_key_edges(members: DataFrame, node: str, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(edges, hubs): a star by key for keys that 2 to `most` nodes share, and the larger keys, which are reported, not linked."""
    distinct = members.where(F.col(key).isNotNull()).select(F.col(node).alias("node"), F.col(key).alias("key")).distinct()
    groups = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    edges = distinct.join(groups.where((F.col("n") >= 2) & (F.col("n") <= most)), "key").select(F.col("first").alias("u"), F.col("node").alias("v")).where("u <> v")
    return edges, groups.where(F.col("n") > most).select("key", "n")
