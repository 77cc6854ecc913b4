"""Queries: market structure, ownership, seller scores, classification of names and buyer reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates
from tidemark.io import orders, table
from tidemark.operators import structure as M
from tidemark.plans.registry import query

UNITS = """u as (select p_type as niche, l_suppkey as unit, count(*) as locations, min(cast(l_shipdate as date)) as first_day from lineitem join part on l_partkey = p_partkey group by 1, 2),
f as (select l_suppkey as unit, count(*) as everywhere from lineitem group by 1),
m as (select niche, sum(locations) as locations, count(*) as providers, round(100.0 * count(*) filter (where locations = 1) / count(*), 6) as single_site_pct, cast(count(*) filter (where everywhere <= 600) as bigint) as indie from u join f using (unit) group by 1),
h as (select niche, sum(power(u.locations / cast(m.locations as double), 2)) as hhi from u join m using (niche) group by 1),
t as (select niche, 100.0 * sum(locations) filter (where rn <= 5) as top from (select *, row_number() over (partition by niche order by locations desc, unit) as rn from u) group by 1),
s as (select m.*, round(hhi, 6) as hhi, round(top / m.locations, 6) as top5 from m join h using (niche) join t using (niche))"""


def units(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("p_type").alias("niche"), F.col("l_suppkey").alias("unit"), F.to_date("l_shipdate").alias("day"))


@query("with " + UNITS + " select niche, cast(locations as bigint) as locations, providers, single_site_pct, indie, hhi, top5 from s")
def hhi_top5(spark, sf_dir):
    """Concentration of each niche; independence is judged on the units' count over all niches."""
    return M.concentration(units(spark, sf_dir), indie_sites=600)


VERDICT = """case when indie is null or indie < 30 then 'Too small to roll up' when hhi >= 0.2 or top5 >= 40 then 'Already consolidated' when hhi >= 0.1 or top5 >= 20 then 'Consolidating' when indie < 100 then 'Thin - regional platform at best' else 'Fragmented - roll-up runway' end"""
SCORE = "case when indie is null or indie < 30 then 0.0 else 0.6 * 100 * least(1.0, indie / 300.0) + 0.4 * 100 * least(1 - least(1.0, hhi / 0.2), 1 - least(1.0, top5 / 40.0)) end"


@query("with " + UNITS + f" select niche, {VERDICT} as verdict, round({SCORE}, 6) as score from s")
def market_verdict(spark, sf_dir):
    rows = M.concentration(units(spark, sf_dir), indie_sites=600)
    return rows.select("niche", M.verdict(F.col("indie"), F.col("hhi"), F.col("top5")).alias("verdict"), F.round(M.headroom_score(F.col("indie"), F.col("hhi"), F.col("top5")), 6).alias("score"))


@query("with " + UNITS + """, a as (select max(cast(l_shipdate as date)) as a from lineitem), e as (select niche, round(100.0 * count(*) filter (where first_day > a - interval 12 month) / count(*), 6) as entry_rate, median(floor((year(a) * 12 + month(a) - year(first_day) * 12 - month(first_day)) / 12)) as median_years from u, a group by 1)
select niche, entry_rate, median_years, case when entry_rate >= 15 then 'INFANT' when entry_rate <= 8 then 'MATURE' else 'SETTLING' end as maturity from e""")
def market_maturity(spark, sf_dir):
    """Entry rate leads, median tenure corroborates."""
    firsts = units(spark, sf_dir).groupBy("niche", "unit").agg(F.min("day").alias("first_day"))
    anchor = table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("a"))
    rows = firsts.crossJoin(F.broadcast(anchor))
    new = F.count_if(F.col("first_day") > F.add_months("a", -12))
    years = F.floor(dates.months_between(F.col("first_day"), F.col("a")) / 12)
    out = rows.groupBy("niche").agg(F.round(100.0 * new / F.count(F.lit(1)), 6).alias("entry_rate"), F.median(years.cast("double")).alias("median_years"))
    return out.withColumn("maturity", M.maturity(F.col("entry_rate")))


@query("""with c as (select c_custkey, count(*) as sites, min(cast(o_orderdate as date)) as since, max(c_acctbal) as bal from customer join orders on c_custkey = o_custkey group by 1), y as (select *, cast(2001 - year(since) - (case when strftime(since, '%m%d') > '0831' then 1 else 0 end) as int) as years from c),
s as (select *, (case when years >= 15 then 12 when years >= 10 then 7 when years >= 7 then 3 when years < 3 then -10 else 0 end) + (case when sites = 1 then 4 when sites <= 3 then 2 else 0 end) as base from y)
select c_custkey, years, cast(least(greatest(base + case when bal > 9000 then 14 else 0 end + case when bal < 0 then -25 else 0 end, 0), 100) as int) as score from s""")
def seller_scores(spark, sf_dir):
    """Tenure, size and ownership signals of each provider."""
    rows = orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey")
    facts = rows.agg(F.count(F.lit(1)).alias("sites"), F.min("day").alias("since"), F.max("c_acctbal").alias("bal"))
    years = dates.years_between(F.col("since"), F.lit("2001-08-31").cast("date"))
    scored = facts.withColumn("years", years).withColumn("base", M.structural_score(F.col("sites"), F.col("years")))
    extra = F.when(F.col("bal") > 9000, M.POINTS["sole"]).otherwise(0) + F.when(F.col("bal") < 0, M.POINTS["group"]).otherwise(0)
    return scored.select("c_custkey", "years", F.least(F.greatest(F.col("base") + extra, F.lit(0)), F.lit(100)).cast("int").alias("score"))


PEOPLE = [
    ("Dr A Patel Physio Ltd", "PATEL, Anand", 1, 1, "Unit 4 Mill Park", ["86900"]), ("J R Hartley Physiotherapy Ltd", "HARTLEY, Jane", 1, 1, "12 Church Lane", ["86900"]), ("Sarah Jones Clinic Ltd", "JONES, Sarah", 1, 1, "3 High Road", ["86900"]),
    ("Sarah Physio Ltd", "BROWN, Sarah", 2, 2, "Suite 2 Office Park", ["86900", "86220"]), ("Northern Dental Group Ltd", "KHAN, Omar", 3, 2, "Floor 1 Works", ["86230"]), ("Glow Skin Studio Ltd", None, None, None, "8 Oak Street", ["96020"]), ("Leeds Physio Ltd", "WOOD, Tim", 1, 1, "9 Bank House", ["86900"]),
]


@query(None)
def company_classes(spark, sf_dir):
    """New companies as real operators, personal services or unknown, with what supports it."""
    rows = spark.createDataFrame(PEOPLE, "name string, director string, n_directors int, psc int, address string, sics array<string>")
    return M.classify_companies(rows)


@query("""with b as (select c_mktsegment as niche, count(*) as locations, count(distinct c_nationkey) as indie, avg(c_acctbal) as x from customer group by 1), r as (select niche, case when x > 5000 then 12.0 when x > 4500 then 3.0 else -12.0 end as t1, case when locations > 300 then 45.0 else 5.0 end as t0, cast(indie as int) * 5 as indie, locations, case when niche < 'F' then 60 else 10 end as new_12m from b)
select niche, case when t1 <= -10 then 'falling' when t1 >= 40 then 'booming' when t1 >= 10 or t0 >= 10 then 'growing' else 'flat' end as demand, case when indie < 30 then 'none' when new_12m / cast(locations as double) >= 0.15 then 'filling' else 'fragmented' end as supply from r""")
def buyer_read(spark, sf_dir):
    """Demand and supply reads of each niche, and so what a buyer can do."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("niche")).agg(F.count(F.lit(1)).alias("locations"), F.countDistinct("c_nationkey").alias("n"), F.avg("c_acctbal").alias("x"))
    rows = rows.select("niche", "locations", (F.col("n") * 5).alias("indie"), F.when(F.col("x") > 5000, 12.0).when(F.col("x") > 4500, 3.0).otherwise(-12.0).alias("t1"), F.when(F.col("locations") > 300, 45.0).otherwise(5.0).alias("t0"), F.when(F.col("niche") < "F", 60).otherwise(10).alias("new_12m"))
    return rows.select("niche", M.demand(F.col("t0"), F.col("t1")).alias("demand"), M.supply(F.col("indie"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("new_12m") / F.col("locations")).alias("supply"))
