"""Places in one order over a whole table, without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stretch(value: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the sorted cuts are at most the value, by nested halves."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(value < F.lit(cuts[middle]), stretch(value, cuts[:middle], first)).otherwise(stretch(value, cuts[middle + 1 :], first + middle + 1))


def places(rows: DataFrame, lead: str, order: list, *, tier: Column | None = None, name: str = "place", most_cuts: int = 1024) -> DataFrame:
    """rows with their place, a long from 1, by tier (a whole number from 0, of few values), the column lead (a number or a time, ascending) and order.

    Rows are dealt by stretches of lead between approximate quantiles; a row's place is its place in its stretch behind the rows of all
    stretches before. Only cuts and counts, one for each stretch of a tier, reach the driver. Rows of equal lead meet in one task, so lead
    should tell most rows apart. Null leads come first; ties in lead and order are placed in any order.
    """
    number = F.col(lead).cast("double")
    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), most_cuts + 1)
    found = rows.agg(F.percentile_approx(number, [k / parts for k in range(1, parts)], 100 * parts).alias("cuts")).first()["cuts"] if parts > 1 else []
    cuts = sorted(set(found or []))
    within = F.when(number.isNull(), F.lit(0)).otherwise(stretch(number, cuts, 1))
    dealt = rows.withColumn("__stretch", (within if tier is None else tier * (len(cuts) + 2) + within).cast("int"))
    sizes = {r["__stretch"]: r["count"] for r in dealt.groupBy("__stretch").count().collect()}
    before, offsets = 0, []
    for at in range(max(sizes, default=0) + 1):
        offsets.append(before)
        before += sizes.get(at, 0)
    line = Window.partitionBy("__stretch").orderBy(F.col(lead).asc_nulls_first(), *order)
    start = F.element_at(F.array(*(F.lit(n).cast("long") for n in offsets)), F.col("__stretch") + 1)
    return dealt.withColumn(name, start + F.row_number().over(line)).drop("__stretch")
