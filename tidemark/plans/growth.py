"""Queries: growth, bases, noise and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates, stats
from tidemark.io import events, orders, table
from tidemark.operators import growth
from tidemark.plans.registry import query

ANCHOR = "(select max(cast(o_orderdate as date)) from orders)"
YEARS = {"latest": (12, 0), "prior": (24, 12)}


def nations(spark, sf_dir):
    """Orders with the nation of their customer."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    placed = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name", "c_mktsegment")
    return orders(spark, sf_dir).join(placed, F.col("o_custkey") == F.col("c_custkey"))


def two_years(spark, sf_dir):
    return growth.window_counts(nations(spark, sf_dir), "n_name", "day", YEARS)


NATION_YEARS = f"""
  select n_name, cast(count(*) filter (where d > a - interval 12 month and d <= a) as bigint) as latest,
    cast(count(*) filter (where d > a - interval 24 month and d <= a - interval 12 month) as bigint) as prior
  from (select n_name, cast(o_orderdate as date) as d, {ANCHOR} as a from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) group by n_name"""


@query(f"""with w as ({NATION_YEARS}),
g as (select *, case when prior <> 0 then (latest / cast(prior as double) - 1) * 100 end as g12, case when prior > 0 then 100 / sqrt(prior) end as noise from w)
select n_name, latest, prior, g12, round(noise, 6) as noise, round(case when latest > 0 and prior > 0 then (exp(ln(latest / cast(prior as double)) - 1.96 * sqrt(1.0 / latest + 1.0 / prior)) - 1) * 100 end, 6) as low,
  round(case when latest > 0 and prior > 0 then (exp(ln(latest / cast(prior as double)) + 1.96 * sqrt(1.0 / latest + 1.0 / prior)) - 1) * 100 end, 6) as high,
  coalesce(prior >= 10 and g12 >= greatest(10, noise), false) as fires
from g where latest >= 4""")
def growth_windows(spark, sf_dir):
    rows = two_years(spark, sf_dir).where(F.col("latest") >= C.MIN_COUNT).withColumn("g12", stats.growth_pct("latest", "prior"))
    ends = {n: F.round(stats.ratio_ci("latest", "prior", u), 6) for n, u in (("low", False), ("high", True))}
    out = rows.withColumns({"noise": F.round(stats.noise_pct("prior"), 6), **ends, "fires": stats.fires("g12", "prior", F.lit(False))})
    return out.orderBy(F.col("g12").desc_nulls_last(), F.col("latest").desc(), "n_name")


SIX = {"m1": (1, 0), "m2": (2, 1), "q1": (3, 0), "q2": (6, 3), "y1": (12, 0), "y2": (24, 12)}


@query(f"""with w as (select c_mktsegment, {", ".join(f"cast(count(*) filter (where d > a - interval {x} month and d <= a - interval {y} month) as bigint) as {n}" for n, (x, y) in SIX.items())}
  from (select c_mktsegment, cast(o_orderdate as date) as d, {ANCHOR} as a from orders join customer on o_custkey = c_custkey) group by c_mktsegment)
select c_mktsegment, m1, m2, q1, q2, y1, y2, case when m2 >= 3 then (m1 / cast(m2 as double) - 1) * 100 end as g1, case when q2 >= 3 then (q1 / cast(q2 as double) - 1) * 100 end as g3,
  case when y2 >= 3 then (y1 / cast(y2 as double) - 1) * 100 end as g12, case when q2 >= 3 and y2 >= 3 then (q1 / cast(q2 as double) - 1) * 100 - (y1 / cast(y2 as double) - 1) * 100 end as accel from w""")
def registrations_six_windows(spark, sf_dir):
    rows = growth.window_counts(nations(spark, sf_dir), "c_mktsegment", "day", SIX)
    quoted = {g: F.when(F.col(p) >= 3, stats.growth_pct(n, p)) for g, n, p in (("g1", "m1", "m2"), ("g3", "q1", "q2"), ("g12", "y1", "y2"))}
    return rows.withColumns(quoted).withColumn("accel", F.col("g3") - F.col("g12"))


@query(f"""with w as ({NATION_YEARS}), c as (select sum(latest) as l, sum(prior) as p from w)
select n_name, case when prior <> 0 then (latest / cast(prior as double) - 1) * 100 end as g12, (l / cast(p as double) - 1) * 100 as control,
  round(case when prior <> 0 then ((1 + ((latest / cast(prior as double) - 1) * 100) / 100) / (1 + ((l / cast(p as double) - 1) * 100) / 100) - 1) * 100 end, 6) as excess from w, c""")
def excess_over_base(spark, sf_dir):
    rows = two_years(spark, sf_dir)
    control = rows.agg(stats.growth_pct(F.sum("latest"), F.sum("prior")).alias("control"))
    both = rows.crossJoin(F.broadcast(control)).withColumn("g12", stats.growth_pct("latest", "prior"))
    return both.select("n_name", "g12", "control", F.round(stats.excess_pct(F.col("g12"), F.col("control")), 6).alias("excess"))


SIGNAL = f"""select p_brand, p_type, cast(sum(case when d > a - interval 12 month and d <= a then 1 else 0 end) as bigint) as latest, cast(sum(case when d > a - interval 24 month and d <= a - interval 12 month then 1 else 0 end) as bigint) as prior
  from (select p_brand, p_type, cast(l_shipdate as date) as d, (select max(cast(l_shipdate as date)) from lineitem) as a from lineitem join part on l_partkey = p_partkey) group by 1, 2"""


def signal_rows(spark, sf_dir):
    """Signal rows: a name (type) in a niche (brand) with its latest count and growth."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("key", F.struct("p_brand", "p_type"))
    counts = growth.window_counts(rows, "key", "day", YEARS)
    return counts.select("key.p_brand", "key.p_type", "latest", "prior", stats.growth_pct("latest", "prior").alias("g12"))


G12 = "case when prior <> 0 then (latest / cast(prior as double) - 1) * 100 end"


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12 from s)
select p_brand, round(sum(greatest(coalesce(latest, 1), 1) * g12) / sum(greatest(coalesce(latest, 1), 1)), 6) as weighted, count(*) as items from g where g12 is not null group by 1""")
def weighted_growth(spark, sf_dir):
    return growth.weighted_growth(signal_rows(spark, sf_dir), "p_brand").withColumn("weighted", F.round("weighted", 6))


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12 from s), b as (select *, case when 1 + g12 / 100 <> 0 then latest / (1 + g12 / 100) end as base from g),
t as (select p_brand, sum(case when base >= 0 then latest end) as latest, sum(case when base >= 0 then base end) as base, count(*) as items from b group by 1)
select p_brand, cast(latest as double) as latest, round(base, 6) as base, items, round(case when base > 0 then (latest / base - 1) * 100 end, 6) as pooled from t""")
def pooled_growth(spark, sf_dir):
    out = growth.pooled_growth(signal_rows(spark, sf_dir), "p_brand")
    return out.withColumns({"base": F.round("base", 6), "pooled": F.round("pooled", 6)})


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12, p_type in ('ECONOMY', 'PROMO') as found from s)
select p_brand, round(sum(greatest(latest, 1) * g12) filter (where not found and g12 is not null) / sum(greatest(latest, 1)) filter (where not found and g12 is not null), 6) as g12,
  count(*) as items, count(*) filter (where not found) as independent_items, count(*) filter (where found) as derived_items from g group by 1""")
def independent_growth(spark, sf_dir):
    """Derived terms get no vote but are counted."""
    rows = signal_rows(spark, sf_dir).withColumn("found", F.col("p_type").isin("ECONOMY", "PROMO"))
    votes = growth.weighted_growth(rows.where(~F.col("found")), "p_brand").select("p_brand", F.round("weighted", 6).alias("g12"))
    counts = rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("found")).alias("independent_items"), F.count_if("found").alias("derived_items"))
    return counts.join(votes, "p_brand", "left").select("p_brand", "g12", "items", "independent_items", "derived_items")


@query(f"""with s as ({SIGNAL}) select p_brand, cast(sum(greatest(coalesce(latest, 1), 1)) as double) as weight, sum(greatest(coalesce(latest, 1), 1)) < 8 as thin from s group by 1""")
def tier_weights(spark, sf_dir):
    weight = F.sum(F.greatest(F.coalesce(F.col("latest"), F.lit(1)), F.lit(1))).cast("double")
    return signal_rows(spark, sf_dir).groupBy("p_brand").agg(weight.alias("weight")).withColumn("thin", F.col("weight") < C.MIN_WEIGHT["t2"])


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12, p_type = 'STANDARD' as ix from s),
t as (select *, case when ix or prior is null or prior <= 0 then 10.0 else greatest(10.0, 100 / sqrt(prior)) end as th from g)
select p_brand, p_type, coalesce(not (not ix and prior < 10) and g12 >= th, false) as fires,
  case when g12 is null then 'no reading' when not ix and prior < 10 then 'base too small' when g12 >= th then null when not ix and th > 10 then 'inside the noise band' else 'not rising' end as why_not,
  ix or coalesce(prior >= 10, true) as show from t""")
def tier_fires(spark, sf_dir):
    rows, index = signal_rows(spark, sf_dir), F.col("p_type") == "STANDARD"
    return rows.select("p_brand", "p_type", stats.fires("g12", "prior", index).alias("fires"), stats.why_not("g12", "prior", index).alias("why_not"), stats.show_pct("prior", index).alias("show"))


@query("""with m as (select o_orderpriority as k, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders group by 1, 2)
select a.k, a.month, a.n, case when b.n <> 0 then (a.n / cast(b.n as double) - 1) * 100 end as g1, case when c.n <> 0 then (a.n / cast(c.n as double) - 1) * 100 end as g3,
  case when d.n <> 0 then (a.n / cast(d.n as double) - 1) * 100 end as g12, case when e.n <> 0 then (a.n / cast(e.n as double) - 1) * 100 end as g60
from m a left join m b on b.k = a.k and b.month = a.month - interval 1 month left join m c on c.k = a.k and c.month = a.month - interval 3 month
left join m d on d.k = a.k and d.month = a.month - interval 12 month left join m e on e.k = a.k and e.month = a.month - interval 60 month""", days=("month",))
def calendar_lags(spark, sf_dir):
    """Growth against the same key 1, 3, 12 and 60 calendar months before; a missing month is null, not small.

    A range frame over month numbers finds the exact month in one sort, with gaps."""
    from pyspark.sql import Window

    months = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("k"), F.trunc("day", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = months.withColumn("m", dates.month_number(F.col("month")))
    line = Window.partitionBy("k").orderBy("m")
    return months.select("k", "month", "n", *(stats.growth_pct("n", F.max("n").over(line.rangeBetween(-lag, -lag))).alias(f"g{lag}") for lag in (1, 3, 12, 60)))


@query("""select case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'acquirable' when c_mktsegment = 'HOUSEHOLD' then 'social_care' when lower(c_mktsegment) like '%auto%' then 'public' else 'unknown' end as class,
 count(*) as n, count(*) filter (where c_mktsegment not in ('BUILDING', 'MACHINERY')) as excluded from customer group by 1""")
def sector_classes(spark, sf_dir):
    """Rows outside the sector are counted, not lost."""
    segment = F.col("c_mktsegment")
    kind = F.when(segment.isin("BUILDING", "MACHINERY"), "acquirable").when(segment == "HOUSEHOLD", "social_care").when(F.lower(segment).contains("auto"), "public").otherwise("unknown")
    return table(spark, sf_dir, "customer").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(kind != "acquirable").alias("excluded"))


@query("""with b as (select l_returnflag as specialty, list_transform(range(0, 10), lambda i: i) as ks, cast(sum(case when l_quantity >= 0 then 1 else 0 end) as bigint) as total,
  """ + ", ".join(f"cast(count(*) filter (where floor(l_quantity / 5) = {i}) as bigint) as w{i}" for i in range(11)) + """ from lineitem group by 1)
select specialty, total, w4 + w5 + w6 + w7 + w8 + w9 + w10 as over_18, w8 + w9 + w10 as over_52, w0 + w1 + w2 + w3 as within from b""")
def waiting_buckets(spark, sf_dir):
    """Array-slice sums over wait buckets."""
    bucket = F.floor(F.col("l_quantity") / 5)
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("specialty")).agg(F.count(F.lit(1)).alias("total"), F.array(*(F.count_if(bucket == i) for i in range(11))).alias("w"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return counts.select("specialty", "total", total(F.slice("w", 5, 7)).alias("over_18"), total(F.slice("w", 9, 3)).alias("over_52"), total(F.slice("w", 1, 4)).alias("within"))


@query("""with m as (select p_brand, median(p_retailprice) as med from part group by 1)
select p_brand, med, round(1.4826 * median(abs(p_retailprice - med)), 6) as robust_sd, avg(p_size) as mean_size from part join m using (p_brand) group by 1, 2""")
def robust_spread(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_size")
    middle = part.groupBy("p_brand").agg(F.median("p_retailprice").alias("med"))
    away = part.join(middle, "p_brand").groupBy("p_brand", "med")
    return away.agg(F.round(1.4826 * F.median(F.abs(F.col("p_retailprice") - F.col("med"))), 6).alias("robust_sd"), F.avg("p_size").alias("mean_size"))


@query("""select cast(year(o_orderdate) as int) as year, count(*) as n, count(*) filter (where o_orderstatus = 'F') as ended, round(100.0 * count(*) filter (where o_orderstatus = 'F') / count(*), 6) as ended_pct from orders group by 1""")
def cohort_survival(spark, sf_dir):
    ended = F.count_if(F.col("o_orderstatus") == "F")
    return orders(spark, sf_dir).groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), ended.alias("ended"), F.round(100.0 * ended / F.count(F.lit(1)), 6).alias("ended_pct"))


@query("""select c_nationkey, c_mktsegment, count(*) as locations, min(o_orderdate)::date as first_day, count(*) filter (where o_orderstatus = 'F') as closed,
 array_to_string(list_sort(list(distinct o_orderpriority)), ',') as kinds from orders join customer on o_custkey = c_custkey group by 1, 2""", days=("first_day",))
def provider_rollup(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    rows = orders(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("locations"), F.min("day").alias("first_day"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("""with s as (select cast(date_trunc('month', o_orderdate) as date) as month, o_orderpriority as key, count(*) as n, count(distinct o_custkey) as companies from orders group by grouping sets ((date_trunc('month', o_orderdate), o_orderpriority), (date_trunc('month', o_orderdate))))
select month, coalesce(key, 'TOTAL') as key, n, companies from s""", days=("month",))
def keyword_months(spark, sf_dir):
    """Counts by month and key, and each month's total with its distinct companies once."""
    rows = orders(spark, sf_dir).withColumn("month", F.trunc("day", "MM"))
    measures = (F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("companies"))
    by_key = rows.groupBy("month", F.col("o_orderpriority").alias("key")).agg(*measures)
    return by_key.unionByName(rows.groupBy("month", F.lit("TOTAL").alias("key")).agg(*measures))


@query("""with e as (select user_id, cast(ts as date) as day, min(ts) as first_ts, count(*) as n from events group by 1, 2) select user_id, day, epoch_us(first_ts) as first_us, n from e""", days=("day",))
def dedupe_earliest(spark, sf_dir):
    """One row for each signature, the earliest."""
    return events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.unix_micros(F.min("ts")).alias("first_us"), F.count(F.lit(1)).alias("n"))


@query("""with m as (select distinct cast(date_trunc('month', o_orderdate) as date) as month from orders), k as (select distinct o_orderpriority as k from orders),
n as (select cast(date_trunc('month', o_orderdate) as date) as month, o_orderpriority as k, count(*) as n from orders group by 1, 2),
ax as (select k, cast(unnest(generate_series((select min(month) from m), (select max(month) from m), interval 1 month)) as date) as month from k)
select ax.k, ax.month, cast(coalesce(n, 0) as bigint) as n, count(n) over (partition by ax.k) / cast(count(*) over (partition by ax.k) as double) >= 0.9 as covered from ax left join n on n.k = ax.k and n.month = ax.month""", days=("month",))
def month_axis_fill(spark, sf_dir):
    """Counts on a dense axis of months, with the gate of 90 % coverage."""
    from pyspark.sql import Window

    counts = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("k"), F.trunc("day", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    axis = counts.select("k").distinct().crossJoin(F.broadcast(span))
    every = Window.partitionBy("k")
    covered = F.count("n").over(every) / F.count(F.lit(1)).over(every).cast("double") >= 0.9
    return axis.join(counts, ["k", "month"], "left").select("k", "month", F.coalesce("n", F.lit(0)).cast("long").alias("n"), covered.alias("covered"))


@query("""with m as (select cast(date_trunc('month', l_shipdate) as date) as month, sum(l_quantity) as items, max(case when l_returnflag = 'R' then l_quantity end) as canary from lineitem group by 1)
select month, items from m where canary >= 50""", days=("month",))
def canary_months(spark, sf_dir):
    """A month counts only if its sentinel shows that it is whole."""
    months = table(spark, sf_dir, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("month"))
    return months.agg(F.sum("l_quantity").alias("items"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("canary")).where("canary >= 50").select("month", "items")


@query("""with k as (select event_type as reason, count(*) as n from events where value < 50 group by 1) select reason, n from k order by n desc, reason limit 8""")
def reason_histogram(spark, sf_dir):
    return events(spark, sf_dir).where("value < 50").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(8)


@query("""with n as (select p_brand, p_type, count(*) as n from part group by 1, 2) select p_brand, arg_max(p_type, (n, p_type)) as term, max(n) as companies from n group by 1""")
def widest_keyword(spark, sf_dir):
    """Overlapping keywords are never summed: the widest one stands."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("term"), F.max("n").alias("companies"))


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12 from s) select p_brand, cast(count(*) filter (where g12 >= 10) as bigint) as fired from g group by 1""")
def fired_tiers(spark, sf_dir):
    return signal_rows(spark, sf_dir).groupBy("p_brand").agg(F.count_if(F.col("g12") >= C.RISING).alias("fired"))


@query("""select event_type, count(*) as n, count(*) filter (where value >= 60) as hits, median(value) filter (where value >= 60) as median_lead,
 round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) as high
from (select event_type, value, 1.96 as z, count(*) over (partition by event_type) as n, count(*) filter (where value >= 60) over (partition by event_type) / cast(count(*) over (partition by event_type) as double) as p from events) group by event_type, z, n, p""".replace("select event_type, count(*) as n, count", "select event_type, cast(count(*) as bigint) as n, count"))
def wilson_scorecard(spark, sf_dir):
    """Hits, median lead and the 95 % interval of the hit rate."""
    sums = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 60).alias("hits"), F.median(F.when(F.col("value") >= 60, F.col("value"))).alias("median_lead"))
    return sums.withColumns({"low": F.round(stats.wilson("hits", "n", False), 6), "high": F.round(stats.wilson("hits", "n", True), 6)})


@query("""with m as (select cast(date_trunc('month', l_shipdate) as date) as month, l_returnflag as code, sum(l_quantity) as items from lineitem where month(l_shipdate) <> 6 or l_returnflag <> 'R' group by 1, 2)
select a.month, sum(case when code in ('A', 'R') then items end) as niche_items, max(case when code = 'R' then 1 else 0 end) = 1 as complete, case when max(case when code = 'R' then 1 else 0 end) = 1 then sum(case when code in ('A', 'R') then items end) end as trusted from m a group by 1""", days=("month",))
def niche_items(spark, sf_dir):
    """Sum of a niche's codes, null where the month lacks one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")).where((F.month("day") != 6) | (F.col("l_returnflag") != "R"))
    complete = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1
    total = F.sum(F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_quantity")))
    return lines.groupBy(F.trunc("day", "MM").alias("month")).agg(total.alias("niche_items"), complete.alias("complete"), F.when(complete, total).alias("trusted"))


@query("""with d as (select doc_id, quality, toxic from labels)
select cast(count(*) filter (where quality = 1 and toxic = 1) as bigint) as tp, cast(count(*) filter (where quality = 1 and toxic = 0) as bigint) as fp, cast(count(*) filter (where quality = 0 and toxic = 1) as bigint) as fn, cast(count(*) filter (where quality = 0 and toxic = 0) as bigint) as tn,
  case when count(*) filter (where toxic = 0) > 0 then count(*) filter (where quality = 1 and toxic = 0) / cast(count(*) filter (where toxic = 0) as double) end as false_rate from d""")
def confusion_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    cell = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return labels.agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"), F.try_divide(cell(1, 0), F.count_if(F.col("toxic") == 0)).alias("false_rate"))
