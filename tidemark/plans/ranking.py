"""Queries: sorts, limits, top-k, retention and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import stats
from tidemark.io import events, orders, table
from tidemark.operators.ranking import places
from tidemark.plans.growth import G12, SIGNAL, signal_rows
from tidemark.plans.registry import query


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12 from s) select p_brand, p_type, latest, g12 from g order by g12 desc nulls last, latest desc, p_brand, p_type limit 40""")
def ranked_rows(spark, sf_dir):
    return signal_rows(spark, sf_dir).select("p_brand", "p_type", "latest", "g12").orderBy(F.col("g12").desc_nulls_last(), F.col("latest").desc(), "p_brand", "p_type").limit(C.MAX_ROWS)


@query("""with n as (select o_orderpriority as k, count(*) as n from orders group by 1), t as (select k, n, 0 as pin from n union all select 'TOTAL', sum(n), 1 from n) select k, cast(n as bigint) as n, cast(row_number() over (order by pin desc, n desc, k) as int) as place from t""")
def pinned_total(spark, sf_dir):
    counts = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.withColumn("pin", F.lit(0)).unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("TOTAL").alias("k"), "n", F.lit(1).alias("pin")))
    # the total is no less than any count and ties with one only if that is alone, where pin decides
    return places(both.withColumn("lead", -F.col("n")), "lead", [F.desc("pin"), "k"]).select("k", "n", F.col("place").cast("int").alias("place"))


@query("""with n as (select p_type, l_suppkey, count(*) as n, row_number() over (partition by p_type order by count(*) desc, l_suppkey) as rn from lineitem join part on l_partkey = p_partkey group by 1, 2) select p_type, l_suppkey, n, cast(rn as int) as rn from n where rn <= 5""")
def top_providers(spark, sf_dir):
    """The five largest of each group; the rank limit applies before the shuffle too."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy("p_type", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "l_suppkey"))).where("rn <= 5")


@query("""with d as (select p_name, max(p_retailprice) as price from part where p_brand <> 'Brand#1' group by 1), c as (select distinct p_name from part where p_brand = 'Brand#1' and p_size < 4) select p_name, price from d where p_name not in (select p_name from c) order by price desc, p_name limit 5""")
def top_distinct(spark, sf_dir):
    """The five best distinct phrases that the core does not have."""
    part = table(spark, sf_dir, "part")
    core = part.where("p_brand = 'Brand#1' and p_size < 4").select("p_name")
    best = part.where("p_brand <> 'Brand#1'").groupBy("p_name").agg(F.max("p_retailprice").alias("price")).join(core, "p_name", "left_anti")
    return best.orderBy(F.desc("price"), "p_name").limit(5)


@query("""with r as (select event_id, event_type = 'error' as breakout, value, case when event_type = 'error' then null else value end as rise from events) select event_id, breakout, rise from r order by breakout desc, rise desc nulls last, event_id limit 30""")
def breakouts_first(spark, sf_dir):
    rows = events(spark, sf_dir)
    is_out = F.col("event_type") == "error"
    return rows.select("event_id", is_out.alias("breakout"), F.when(~is_out, F.col("value")).alias("rise")).orderBy(F.desc("breakout"), F.col("rise").desc_nulls_last(), "event_id").limit(30)


@query("""with d as (select distinct user_id, cast(ts as date) as day from events), r as (select *, row_number() over (partition by user_id order by day desc) as rn from d) select user_id, day from r where rn <= 10""", days=("day",))
def keep_last(spark, sf_dir):
    """Retention: the ten newest snapshots of each key."""
    rows = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where("rn <= 10").drop("rn")


@query("""with r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_custkey) as rn from customer) select c_mktsegment, c_custkey from r order by rn, c_mktsegment limit 42""")
def round_robin_sample(spark, sf_dir):
    """A deterministic stratified sample: the first of each stratum, then the second, ..."""
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", rank.alias("rn")).where("rn <= 42").orderBy("rn", "c_mktsegment").limit(42).drop("rn")


@query("""select n_name, sha256('control|2024-W05|' || n_name) as draw from nation order by draw limit 3""")
def control_draw(spark, sf_dir):
    """Random controls that anyone can draw again: the names whose hash with the week is smallest."""
    draw = F.sha2(F.concat(F.lit("control|2024-W05|"), "n_name"), 256)
    return table(spark, sf_dir, "nation").select("n_name", draw.alias("draw")).orderBy("draw").limit(3)


@query("""with p as (select p_type as seed, max(p_partkey) as last_polled, min(p_partkey) as ord from part where p_size > 49 group by 1), s as (select distinct p_type as seed from part) select s.seed from s left join p using (seed) order by coalesce(last_polled, -1), s.seed limit 4""")
def seed_rotation(spark, sf_dir):
    """The seeds polled least recently come first; those never polled before all."""
    part = table(spark, sf_dir, "part")
    polled = part.where("p_size > 49").groupBy(F.col("p_type").alias("seed")).agg(F.max("p_partkey").alias("last"))
    return part.select(F.col("p_type").alias("seed")).distinct().join(polled, "seed", "left").orderBy(F.coalesce("last", F.lit(-1)), "seed").limit(4).select("seed")


@query("""with w as (select p_brand, p_type, count(*) as have, max(p_retailprice) as worth from part group by 1, 2) select p_brand, p_type, cast(row_number() over (order by have < 12 desc, worth desc, p_brand, p_type) as int) as place from w""")
def fetch_priority(spark, sf_dir):
    """The order of work: gaps first, then by worth."""
    work = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("have"), F.max("p_retailprice").alias("worth"))
    placed = places(work.withColumn("lead", -F.col("worth")), "lead", ["p_brand", "p_type"], tier=F.when(F.col("have") < 12, 0).otherwise(1))
    return placed.select("p_brand", "p_type", F.col("place").cast("int").alias("place"))


@query("""with n as (select cast(year(o_orderdate) as int) as y, o_orderpriority as k, count(*) as n from orders where year(o_orderdate) in (1999, 2000) group by 1, 2), r as (select *, row_number() over (partition by y order by n desc, k) as rn from n)
select a.k, cast(a.rn as int) as place, a.n as now from r a where a.y = 2000 and a.rn <= 3 and not exists (select 1 from r b where b.y = 1999 and b.rn <= 3 and b.k = a.k)""")
def entered_top(spark, sf_dir):
    """Names that entered the top three since the baseline."""
    year = F.year("day")
    counts = orders(spark, sf_dir).where(year.isin(1999, 2000)).groupBy(year.alias("y"), F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "k"))).where(F.col("place") <= C.TOP_N)
    return top.where("y = 2000").join(top.where("y = 1999").select("k"), "k", "left_anti").select("k", "place", F.col("n").alias("now"))


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12 from s) select p_brand, p_type, latest, prior, g12 from g where g12 >= 50 and (latest < 40 or latest / (1 + g12 / 100) < 40) order by g12 desc, p_brand, p_type limit 5""")
def thin_rows(spark, sf_dir):
    """Large percentages on small counts."""
    rows = signal_rows(spark, sf_dir)
    base = stats.number("latest") / (1 + F.col("g12") / 100)
    return rows.where((F.col("g12") >= 50) & ((F.col("latest") < 40) | (base < 40))).orderBy(F.desc("g12"), "p_brand", "p_type").limit(5)
