"""Queries: windows over monthly series, onsets, clusters of dates, bursts and hash chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates, stats
from tidemark.io import events, orders, table
from tidemark.operators import series as S
from tidemark.plans.registry import query

MONTHLY = """n as (select o_orderpriority as series, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders group by 1, 2),
ax as (select series, cast(unnest(generate_series((select min(month) from n), (select max(month) from n), interval 1 month)) as date) as month from (select distinct series from n)),
s as (select ax.series, ax.month, cast(row_number() over (partition by ax.series order by ax.month) - 1 as int) as t, cast(coalesce(n, 0) as double) as v from ax left join n on n.series = ax.series and n.month = ax.month)"""


def monthly(spark, sf_dir):
    """Orders by month: a series for each priority."""
    counts = orders(spark, sf_dir).groupBy("o_orderpriority", F.trunc("day", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return S.dense(counts, "o_orderpriority", "month", "n")


ROLL = "case when t >= 11 then sum(v) over (partition by series order by t rows between 11 preceding and current row) end"
TRIM = "case when t >= 11 then sum(v) over (partition by series order by t rows between 11 preceding and current row) - max(v) over (partition by series order by t rows between 11 preceding and current row) end"


@query(f"with {MONTHLY} select series, month, {ROLL} as r, {TRIM} as rt from s", days=("month",))
def rolling12(spark, sf_dir):
    return monthly(spark, sf_dir).select("series", "month", S.rolling_sum().alias("r"), S.trimmed_sum().alias("rt"))


BASE = """case when count({r}) over w >= 7 then median({r}) over w end"""
FRAME = "window w as (partition by series order by t rows between 24 preceding and 12 preceding)"


@query(f"with {MONTHLY}, r as (select *, {ROLL} as r from s) select series, month, {BASE.format(r='r')} as baseline from r {FRAME}", days=("month",))
def lagged_median(spark, sf_dir):
    return monthly(spark, sf_dir).withColumn("r", S.rolling_sum()).select("series", "month", S.lagged_median("r").alias("baseline"))


SCORES = f"""{MONTHLY}, r as (select *, {ROLL} as r, {TRIM} as rt from s), b as (select *, {BASE.format(r='r')} as b, {BASE.format(r='rt')} as bt from r {FRAME}),
g as (select *, case when b is not null and bt is not null and r is not null then ln((r + 3.0) / (b + 3.0)) end as g, case when b is not null and bt is not null and r is not null then sqrt(1 / (r + 3.0) + 1 / (b + 3.0)) end as se, case when b is not null and bt is not null and r is not null then ln((rt + 3.0) / (bt + 3.0)) end as gt from b),
z0 as (select *, g / se as z0 from g), l as (select *, list(z0) filter (where z0 is not null) over (partition by series order by t rows between 24 preceding and 1 preceding) as before from z0),
m as (select *, case when z0 is not null and len(before) >= 24 then (list_sort(before)[12] + list_sort(before)[13]) / 2 end as med from l),
d as (select *, case when med is not null then list_sort(list_transform(before, lambda x: abs(x - med))) end as dev from m),
z as (select *, case when med is not null then (z0 - med) / greatest(1.4826 * (dev[12] + dev[13]) / 2, 1.0) end as z from d)"""


@query(f"with {SCORES} select series, month, round(g, 6) as g, round(gt, 6) as gt, round(z, 6) as z from z", days=("month",))
def robust_scores(spark, sf_dir):
    return S.growth_scores(monthly(spark, sf_dir)).select("series", "month", *(F.round(c, 6).alias(c) for c in ("g", "gt", "z")))


ONSET = f"""{SCORES}, h as (select *, coalesce(g >= ln({{x}}) and gt >= ln(1 + ({{x}} - 1) * 0.6) and z >= {{z}} and r >= 12 and count(z) over w = 3 and min(z) over w >= {{k}}, false) as hit from z window w as (partition by series order by t rows between 1 following and 3 following))
select series, min(t) filter (where hit) as onset_t, round(max(z), 6) as peak_z, count(z) as testable, round(arg_max(r, t), 6) as latest_12m, sum(v) as total from h group by 1"""


@query("with " + ONSET.format(x=1.5, z=3.0, k=1.5))
def onset_robust(spark, sf_dir):
    found = S.onsets(monthly(spark, sf_dir), min_level=C.FLOORS["T2"])
    return found.select("series", "onset_t", F.round("peak_z", 6).alias("peak_z"), "testable", F.round("latest_12m", 6).alias("latest_12m"), "total")


def injected(spark, sf_dir):
    """The monthly series with a boom planted in them: from month 56 on, the urgent ones run at four times their level."""
    boom = F.when((F.col("t") >= 56) & F.col("series").isin("1-URGENT", "2-HIGH"), F.col("v") * 4).otherwise(F.col("v"))
    return monthly(spark, sf_dir).withColumn("v", boom)


@query("with " + ONSET.format(x=1.5, z=3.0, k=1.5).replace("as v from ax", "* (case when row_number() over (partition by ax.series order by ax.month) - 1 >= 56 and ax.series in ('1-URGENT', '2-HIGH') then 4 else 1 end) as v from ax"))
def onset_injected(spark, sf_dir):
    found = S.onsets(injected(spark, sf_dir), min_level=C.FLOORS["T2"])
    return found.select("series", "onset_t", F.round("peak_z", 6).alias("peak_z"), "testable", F.round("latest_12m", 6).alias("latest_12m"), "total")


@query(f"""with {MONTHLY}, g as (select *, t >= 12 and lag(v, 12) over (partition by series order by t) = 0 as undef, case when lag(v, 12) over (partition by series order by t) <> 0 then v / lag(v, 12) over (partition by series order by t) - 1 end as g from s),
z as (select *, case when g is not null and count(g) over w >= 24 and stddev_pop(g) over w > 0 then (g - avg(g) over w) / stddev_pop(g) over w end as z from g window w as (partition by series order by t rows between 24 preceding and 1 preceding)),
h as (select *, coalesce(z >= 2.0 and count(z) over w = 2 and min(z) over w >= 1.0, false) as hit from z window w as (partition by series order by t rows between 1 following and 2 following))
select series, min(t) filter (where hit) as onset_t, count(*) filter (where undef) as undefined, count(z) as testable from h group by 1""")
def onset_plain(spark, sf_dir):
    return S.plain_onsets(monthly(spark, sf_dir))


@query(f"""with {MONTHLY}, c as (select series, t, v, month(month) <> 7 or series <> '2-HIGH' as complete from s), w as (select *, sum(case when complete then v end) over (partition by series order by t rows between 11 preceding and current row) as x, count(*) filter (where complete) over (partition by series order by t rows between 11 preceding and current row) as k from c)
select series, t, case when k = 12 then x end as w12 from w""")
def complete_window(spark, sf_dir):
    """A 12-month sum; null if any of its months is missing or incomplete."""
    rows = monthly(spark, sf_dir).withColumn("complete", (F.month("month") != 7) | (F.col("series") != "2-HIGH"))
    frame = S.rows(11)
    known = F.when(F.col("complete"), F.col("v"))
    return rows.select("series", "t", F.when(F.count(known).over(frame) == 12, F.sum(known).over(frame)).alias("w12"))


@query(f"""with {MONTHLY}, f as (select series, coalesce(min(t) filter (where v < 25), 1000000) as gap from s group by 1) select series, cast(count(*) as bigint) as months, sum(v) as total from s join f using (series) where t < gap group by 1""")
def longest_prefix(spark, sf_dir):
    """The sum over the months before the first one that falls short."""
    rows = monthly(spark, sf_dir)
    gap = rows.groupBy("series").agg(F.coalesce(F.min(F.when(F.col("v") < 25, F.col("t"))), F.lit(1_000_000)).alias("gap"))
    return rows.join(gap, "series").where("t < gap").groupBy("series").agg(F.count(F.lit(1)).alias("months"), F.sum("v").alias("total"))


@query("""with d as (select event_type, cast(ts as date) as day, sum(value) as v from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by day desc) as rn, row_number() over (partition by event_type order by day) as up from d)
select event_type, round(avg(v) filter (where rn <= 4), 6) as now, round(avg(v) filter (where rn between 5 and 8), 6) as before, round(avg(v) filter (where rn between 14 and 17), 6) as quarter, round(avg(v) filter (where up <= 4), 6) as start from r group by 1""")
def index_means(spark, sf_dir):
    """Means of four points: the last four, the four before, those a quarter back, and the first."""
    daily = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    by = Window.partitionBy("event_type")
    rows = daily.withColumns({"rn": F.row_number().over(by.orderBy(F.desc("day"))), "up": F.row_number().over(by.orderBy("day"))})
    mean = lambda cond: F.round(F.avg(F.when(cond, F.col("v"))), 6)
    return rows.groupBy("event_type").agg(mean(F.col("rn") <= 4).alias("now"), mean(F.col("rn").between(5, 8)).alias("before"), mean(F.col("rn").between(14, 17)).alias("quarter"), mean(F.col("up") <= 4).alias("start"))


@query("""with a as (select max(cast(o_orderdate as date)) as a from orders), m as (select o_orderkey, cast(o_orderdate as date) as d, a, (year(a) * 12 + month(a)) - (year(o_orderdate) * 12 + month(o_orderdate)) as m, o_custkey, o_orderpriority from orders, a),
b as (select *, case when m < 4 then 'p3' when m < 8 then 'p2' when m < 12 then 'p1' when m < 24 then 'prior12' else 'pre24' end as bucket from m) select o_orderpriority, bucket, count(*) as mentions, count(distinct o_custkey) as operators from b group by 1, 2""")
def trajectory_buckets(spark, sf_dir):
    rows = orders(spark, sf_dir)
    both = rows.crossJoin(F.broadcast(rows.agg(F.max("day").alias("anchor"))))
    return both.groupBy("o_orderpriority", dates.bucket(F.col("day"), F.col("anchor")).alias("bucket")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("o_custkey").alias("operators"))


@query("""with d as (select o_custkey, cast(o_orderdate as date) as d from orders), l as (select *, lead(d, 3) over (partition by o_custkey order by d) as later from d) select o_custkey, bool_or(coalesce(later - d <= 120, false)) as clustered, count(*) as n from l group by 1""")
def date_cluster(spark, sf_dir):
    """Whether four of the dates lie within 120 days."""
    later = F.lead("day", C.SPV_MIN_CLUSTER - 1).over(Window.partitionBy("o_custkey").orderBy("day"))
    rows = orders(spark, sf_dir).withColumn("near", F.coalesce(F.datediff(later, F.col("day")) <= C.SPV_WINDOW_DAYS, F.lit(False)))
    return rows.groupBy("o_custkey").agg(F.bool_or("near").alias("clustered"), F.count(F.lit(1)).alias("n"))


BODY = "'{{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}}'".replace("{{", "{").replace("}}", "}")


@query(f"""with recursive b as (select n_nationkey as k, {BODY} as body from nation), chain(k, body, prev, hash) as (
 select k, body, repeat('0', 64), sha256(repeat('0', 64) || body) from b where k = 0 union all select b.k, b.body, c.hash, sha256(c.hash || b.body) from chain c join b on b.k = c.k + 1)
select k, hash, true as ok from chain""")
def hash_chain(spark, sf_dir):
    """Each entry's hash covers the one before; verification looks at neighbours only."""
    bodies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit('{"key":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"'), F.col("n_name"), F.lit('"}')).alias("body"))
    from tidemark.operators.chain import append, verify

    return verify(append(bodies, "k", "body"), "k").select("k", "hash", "ok")


@query("""select user_id, event_type, count(*) over (partition by user_id, event_type) as same, len(list(distinct event_type) over (partition by user_id)) as kinds, count(*) over (partition by user_id, event_type) > 1 as ambiguous from events""")
def group_sizes(spark, sf_dir):
    rows = events(spark, sf_dir)
    both = F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type"))
    kinds = F.size(F.collect_set("event_type").over(Window.partitionBy("user_id")))
    return rows.select("user_id", "event_type", both.alias("same"), kinds.cast("long").alias("kinds"), (both > 1).alias("ambiguous"))


@query(f"""with {MONTHLY}, r as (select *, {ROLL} as r from s) select series, t, case when r is not null and lag(r, 12) over (partition by series order by t) <> 0 then (r / lag(r, 12) over (partition by series order by t) - 1) * 100 end as yoy from r""")
def yoy_of_sums(spark, sf_dir):
    """The last twelve months against the twelve before."""
    rows = monthly(spark, sf_dir).withColumn("r", S.rolling_sum())
    return rows.select("series", "t", stats.growth_pct("r", F.lag("r", 12).over(S.line())).alias("yoy"))


@query(f"""with {SCORES}, c as (select unnest([50, 60, 70]) as cutoff), h as (select series, t, coalesce(g >= ln(1.25) and z >= 1.5 and count(z) over w = 3 and min(z) over w >= 0.5, false) as hit from z window w as (partition by series order by t rows between 1 following and 3 following))
select series, cutoff, min(t) filter (where hit and t + 3 <= cutoff) as onset_t, case when min(t) filter (where hit) is null then 'never' when min(t) filter (where hit and t + 3 <= cutoff) is null then 'not yet knowable' else 'known' end as standing from h, c group by 1, 2""")
def standing_at_cutoff(spark, sf_dir):
    """What each series shows at earlier cut-offs: an onset counts once the months that confirm it are in."""
    scored = S.growth_scores(monthly(spark, sf_dir))
    after = S.rows(-1, -3)
    hit = F.coalesce((F.col("g") >= F.ln(F.lit(1.25))) & (F.col("z") >= 1.5) & (F.count("z").over(after) == 3) & (F.min("z").over(after) >= 0.5), F.lit(False))
    rows = scored.withColumn("hit", hit).withColumn("cutoff", F.explode(F.array(*map(F.lit, (50, 60, 70)))))
    known = F.min(F.when(F.col("hit") & (F.col("t") + 3 <= F.col("cutoff")), F.col("t")))
    standing = F.when(F.max("hit") == F.lit(False), "never").when(known.isNull(), "not yet knowable").otherwise("known")
    return rows.groupBy("series", "cutoff").agg(known.alias("onset_t"), standing.alias("standing"))
