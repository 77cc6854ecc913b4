"""Discovery of unclassified rising phrases: distinct operators by period, velocity, score and a ladder of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import stats
from tidemark.operators import components

BUCKETS = ("p1", "p2", "p3", "prior12", "pre24")


def accumulate(mentions: DataFrame, min_count: int = C.MIN_COUNT) -> DataFrame:
    """mentions (phrase, bucket, op, region, context) to one row a phrase.

    Mentions are first reduced to one row for each phrase, operator and region, so that a common phrase is spread over its operators
    and no row is copied for each distinct count; sums of flags by operator and by region are then the distinct counts.
    """
    recent = F.col("bucket").isin("p1", "p2", "p3")
    flag = lambda c: F.max(c.cast("int"))
    cells = mentions.groupBy("phrase", "op", "region").agg(
        *(flag(F.coalesce(F.col("bucket") == b, F.lit(False))).alias(b) for b in BUCKETS), F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("mentions_12m"), F.count_if(recent & F.col("context")).alias("in_context"),
    )
    by_op = cells.groupBy("phrase", "op").agg(*(F.max(b).alias(b) for b in BUCKETS), *(F.sum(c).alias(c) for c in ("n", "mentions_12m", "in_context")))
    sums = by_op.groupBy("phrase").agg(
        *(F.sum(b).alias(b) for b in BUCKETS), F.sum(F.greatest("p1", "p2", "p3")).alias("operators"), *(F.sum(c).alias(c) for c in ("n", "mentions_12m", "in_context")),
    ).where(F.col("n") >= min_count)
    places = cells.where("mentions_12m > 0").select("phrase", "region").distinct().groupBy("phrase").agg(F.count("region").alias("regions"))
    both = sums.join(places, "phrase", "left")
    return both.select("phrase", *BUCKETS, "operators", "mentions_12m", F.coalesce("regions", F.lit(0).cast("long")).alias("regions"), F.try_divide(100.0 * F.col("in_context"), F.col("mentions_12m")).alias("clinical_pct"))


def velocity(p: DataFrame) -> DataFrame:
    """Adds lift, monotone, z_shape, yoy_ratio, z_yoy and age."""
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    age = F.when((F.col("pre24") == 0) & (F.col("prior12") == 0), "unseen_before").when(F.col("pre24") == 0, "recent").otherwise("established")
    return p.withColumns({
        "lift": stats.lift("p3", "p1"), "monotone": ((p3 > p2) & (p2 > p1)) | ((p3 > p2) & (p2 == 0) & (p1 == 0)), "z_shape": stats.count_z("p3", "p1"),
        "yoy_ratio": stats.lift("operators", "prior12"), "z_yoy": stats.count_z("operators", "prior12"), "age": age,
    })


def score(tail: list[str]) -> Column:
    """Rate of rise, weighted by how many unrelated operators show it."""
    treatment = F.exists(F.split("phrase", " "), lambda w: w.isin(tail))
    shape = (
        C.W_LIFT * F.least(F.col("lift"), F.lit(C.LIFT_CAP)) + C.W_YOY * F.least(F.col("yoy_ratio"), F.lit(C.YOY_CAP)) + F.when(F.col("monotone"), C.W_MONOTONE).otherwise(0.0)
        + F.when(treatment, C.W_SELF_CLINICAL).otherwise(0.0) + C.W_NOVELTY * F.when(F.col("age") == "unseen_before", 2.0).when(F.col("age") == "recent", 1.0).otherwise(0.0)
    )
    return F.ln(1 + F.col("operators")) * F.greatest(shape, F.lit(0.0)) * (1 + C.CTX_BONUS * F.coalesce(F.col("clinical_pct"), F.lit(0.0)) / 100)


def judge(taken: Column, min_operators: int = C.MIN_OPERATORS, min_regions: int = C.MIN_REGIONS) -> Column:
    """The first reason to drop a phrase; null if it stays."""
    rising = F.greatest(F.col("z_yoy"), F.col("z_shape")) >= C.Z_MIN
    return (
        F.when(taken, "already tracked")
        .when(F.col("mentions_12m") < C.MIN_COUNT, "too few mentions")
        .when(F.col("operators") < min_operators, "too few operators")
        .when(F.col("mentions_12m") / F.col("operators") > C.MAX_MENTIONS_PER_OPERATOR, "a chain")
        .when((F.col("regions") > 0) & (F.col("regions") < min_regions), "one place")
        .when(~F.coalesce(rising, F.lit(False)), "not rising")
    )


def collapse(phrases: DataFrame, links: DataFrame, usage: float = 0.8) -> DataFrame:
    """(phrase, representative, family_score) of phrases (phrase, operators, score): those that links (u, v) connect are one discovery.

    A family is a connected component and as strong as its best member, which stands for it unless longer members contain it and at least
    that share of its operators use them: then the longest, as the extra words are part of the name. A phrase without links is its own family.
    """
    parts = components.components(links).select(F.col("node").alias("phrase"), "component")
    members = phrases.join(parts, "phrase", "left").withColumn("family", F.coalesce("component", "phrase")).withColumn("words", F.size(F.split("phrase", " ")))
    best = members.groupBy("family").agg(F.min(F.struct((-F.col("score")).alias("minus"), "phrase", "operators", "words")).alias("best"))
    both = members.join(best, "family")
    inside = F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("best.phrase"), F.lit(" ")))
    part_of_name = inside & (F.col("words") > F.col("best.words")) & (F.col("operators") >= usage * F.col("best.operators"))
    place = F.struct((-F.col("words")).alias("w"), (-F.col("score")).alias("s"), "phrase")
    heads = both.groupBy("family").agg(F.first("best").alias("best"), F.min(F.when(part_of_name, place)).alias("longer"))
    heads = heads.select("family", F.coalesce("longer.phrase", "best.phrase").alias("representative"), (-F.col("best.minus")).alias("family_score"))
    return members.join(heads, "family").select("phrase", "representative", "family_score")
