"""Queries: the stack, movement, discovery, adoption, forecasts, and statistics of small samples."""

from __future__ import annotations

import functools
import itertools
import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates, stats
from tidemark.io import events, orders, table
from tidemark.operators import discovery, forecasts, panel, stack
from tidemark.operators import series as S
from tidemark.plans.growth import G12, SIGNAL, signal_rows
from tidemark.plans.registry import query
from tidemark.plans.series import SCORES, injected
from tidemark.shipping import ship

TYPES = {"STANDARD": "t1", "ECONOMY": "t2", "PROMO": "t3", "LARGE": "t4"}
TIER = "case p_type when 'STANDARD' then 't1' when 'ECONOMY' then 't2' when 'PROMO' then 't3' when 'LARGE' then 't4' else 't0' end"


def tier_rows(spark, sf_dir):
    named = F.coalesce(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p))[F.col("p_type")], F.lit("t0"))
    return signal_rows(spark, sf_dir).select(named.alias("tier"), F.col("p_brand").alias("niche"), "latest", "prior", "g12")


def _fires(t: str) -> str:
    if t == "t1":
        return "coalesce(t1 >= 10, false)"
    return f"coalesce(not coalesce(b_{t} < 10, false) and {t} >= case when b_{t} is null or b_{t} <= 0 then 10.0 else greatest(10.0, 100 / sqrt(b_{t})) end, false)"


STACK = f"""s as ({SIGNAL}), g as (select {TIER} as tier, p_brand as niche, latest, {G12} as g12 from s), b as (select *, case when 1 + g12 / 100 <> 0 and latest / (1 + g12 / 100) >= 0 then latest / (1 + g12 / 100) end as base from g),
p as (select tier, niche, case when sum(base) > 0 then (sum(case when base is not null then latest end) / sum(base) - 1) * 100 end as pooled, round(sum(base)) as base from b group by 1, 2),
w as (select niche, {", ".join(f"max(case when tier = '{t}' then pooled end) as {t}, max(case when tier = '{t}' then base end) as b_{t}" for t in ("t0", *C.TIERS))} from p group by 1),
f as (select *, {", ".join(f"{_fires(t)} as f_{t}" for t in ("t0", *C.TIERS))} from w),
d as (select *, case when greatest(case when f_t0 then t0 end, case when f_t1 then t1 end) >= 40 then 'booming' when f_t0 or f_t1 then 'growing' when coalesce(t1, t0) is null then 'unknown' when coalesce(t1, t0) <= -10 then 'falling' else 'flat' end as demand from f),
q as (select *, case when demand = 'falling' and not (f_t1 or f_t2) then 'cooling' when not (f_t1 or f_t2 or f_t3 or f_t4) then case when t1 is not null or t2 is not null or t3 is not null then 'quiet' else 'nodata' end
 when f_t4 then case when f_t1 or f_t2 then 'mainstream' else 'cooling' end when f_t3 then case when f_t1 or f_t2 then 'building' else 'cooling' end when f_t2 then 'emerging' else 'early' end as stage from d)"""


@query(f"with {STACK} select niche, round(t1, 6) as t1, round(t2, 6) as t2, round(t3, 6) as t3, round(t4, 6) as t4, demand, stage from q")
def stack_stages(spark, sf_dir):
    built = stack.build(tier_rows(spark, sf_dir)).orderBy(*stack.order())
    return built.select("niche", *(F.round(t, 6).alias(t) for t in C.TIERS), "demand", "stage")


SNAP = f"""s as ({SIGNAL}), g as (select {TIER} as tier, p_brand as niche, latest, prior, {G12} as g12 from s)"""


@query(f"""with {SNAP}, n as (select tier || '/' || niche as key, sum(greatest(latest, 1) * g12) / sum(greatest(latest, 1)) as now, cast(sum(greatest(latest, 1)) as double) as weight from g where g12 is not null and niche <> 'Brand#7' group by 1),
p as (select tier || '/' || niche as key, 12.5 - (latest % 7) as was from g where niche <> 'Brand#9' and tier <> 't0'),
j as (select coalesce(n.key, p.key) as key, was, now, coalesce(weight, 0) < 60 as thin from n full join p on n.key = p.key)
select key, was, round(now, 6) as now, case when now is null then case when was >= 10 then 'dropped out' end when was is null then case when now < 10 then null when thin then 'new but thin' when now < 12 then 'new in noise band' else 'new' end
 when (was >= 10) = (now >= 10) then null when thin then 'crossed but thin' when abs(now - 10) < 2 or abs(was - 10) < 2 then 'wobble' when now >= 10 then 'up' else 'down' end as move from j""".replace("select tier || '/' || niche as key, 12.5 - (latest % 7) as was from g", "select tier || '/' || niche as key, max(cast(12.5 - (latest % 7) as double)) as was from g").replace("tier <> 't0')", "tier <> 't0' group by 1)"))
def crossings(spark, sf_dir):
    rows = tier_rows(spark, sf_dir).withColumn("key", F.concat_ws("/", "tier", "niche"))
    weight = F.greatest(F.col("latest"), F.lit(1))
    now = rows.where("g12 is not null and niche <> 'Brand#7'").groupBy("key").agg((F.sum(weight * F.col("g12")) / F.sum(weight)).alias("now"), F.sum(weight).cast("double").alias("weight"))
    prev = rows.where("niche <> 'Brand#9' and tier <> 't0'").groupBy("key").agg(F.max(12.5 - F.col("latest") % 7).alias("was"))
    return stack.crossings(now, prev, 60.0).select("key", F.col("was").cast("double").alias("was"), F.round("now", 6).alias("now"), "move")


@query(f"""with {SNAP}, w as (select niche, {", ".join(f"sum(case when tier = '{t}' then greatest(latest, 1) * g12 end) / sum(case when tier = '{t}' and g12 is not null then greatest(latest, 1) end) as {t}" for t in ("t1", "t2", "t3"))},
 cast(sum(case when tier = 't1' then greatest(latest, 1) end) as double) as w1, cast(sum(case when tier = 't2' then greatest(latest, 1) end) as double) as w2 from g group by 1)
select niche, cast((coalesce(t1 >= 10, false) and coalesce(w1, 0) >= 15)::int + (coalesce(t2 >= 10, false) and coalesce(w2, 0) >= 8)::int as int) as lit, round(t1, 6) as t1, round(t2, 6) as t2, round(t3, 6) as t3, t3 is null as t3_absent from w
where ((coalesce(t1 >= 10, false) and coalesce(w1, 0) >= 15) or (coalesce(t2 >= 10, false) and coalesce(w2, 0) >= 8)) and not coalesce(t3 >= 10, false)""")
def watchlist(spark, sf_dir):
    rows = tier_rows(spark, sf_dir)
    weight = F.greatest(F.col("latest"), F.lit(1))
    of = lambda t: F.col("tier") == t
    means = [(F.sum(F.when(of(t), weight * F.col("g12"))) / F.sum(F.when(of(t) & F.col("g12").isNotNull(), weight))).alias(t) for t in ("t1", "t2", "t3")]
    wide = rows.groupBy("niche").agg(*means, F.sum(F.when(of("t1"), weight)).cast("double").alias("w1"), F.sum(F.when(of("t2"), weight)).cast("double").alias("w2"))
    return stack.watchlist(wide).withColumns({t: F.round(t, 6) for t in ("t1", "t2", "t3")})


@query("""with d as (select cast(ts as date) as day, event_type as niche, round(avg(value), 9) as g from events group by 1, 2), now as (select max(day) as day from d), b as (select d.niche, arg_max(g, d.day) as was, max(d.day) as base_day from d, now where d.day <= now.day - 7 group by 1)
select d.niche, round(g, 6) as now, round(was, 6) as was, cast(base_day as varchar) as base_day from d join now on d.day = now.day left join b on b.niche = d.niche""")
def whats_moved(spark, sf_dir):
    """The newest snapshot against the newest one at least a week older."""
    daily = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("niche")).agg(F.round(F.avg("value"), 9).alias("g"))
    both = daily.crossJoin(F.broadcast(daily.agg(F.max("day").alias("newest"))))
    old = F.col("day") <= F.date_sub("newest", 7)
    out = both.groupBy("niche").agg(F.max(F.when(F.col("day") == F.col("newest"), F.col("g"))).alias("now"), F.max(F.when(old, F.struct("day", "g"))).alias("b"))
    return out.where("now is not null").select("niche", F.round("now", 6).alias("now"), F.round("b.g", 6).alias("was"), F.col("b.day").cast("string").alias("base_day"))


@query("""with a as (select max(cast(l_shipdate as date)) as a from lineitem), m as (select l_suppkey as op, s_nationkey as region, l_returnflag = 'R' as context, (year(a) * 12 + month(a)) - (year(l_shipdate) * 12 + month(l_shipdate)) as k, unnest([p_name, split_part(p_name, ' ', 1)]) as phrase from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey, a),
b as (select *, case when k < 4 then 'p3' when k < 8 then 'p2' when k < 12 then 'p1' when k < 24 then 'prior12' else 'pre24' end as bucket from m),
p as (select phrase, count(distinct op) filter (where bucket = 'p1') as p1, count(distinct op) filter (where bucket = 'p2') as p2, count(distinct op) filter (where bucket = 'p3') as p3, count(distinct op) filter (where bucket = 'prior12') as prior12, count(distinct op) filter (where bucket = 'pre24') as pre24,
 count(distinct op) filter (where k < 12) as operators, count(*) filter (where k < 12) as mentions_12m, count(distinct region) filter (where k < 12) as regions, case when count(*) filter (where k < 12) > 0 then 100.0 * count(*) filter (where k < 12 and context) / count(*) filter (where k < 12) end as clinical_pct from b group by 1 having count(*) >= 4),
v as (select *, (p3 + 0.5) / (p1 + 0.5) as lift, (p3 > p2 and p2 > p1) or (p3 > p2 and p2 = 0 and p1 = 0) as monotone, case when p3 + p1 > 0 then (p3 - p1) / sqrt(p3 + p1) end as z_shape, (operators + 0.5) / (prior12 + 0.5) as yoy_ratio, case when operators + prior12 > 0 then (operators - prior12) / sqrt(operators + prior12) end as z_yoy,
 case when pre24 = 0 and prior12 = 0 then 'unseen_before' when pre24 = 0 then 'recent' else 'established' end as age from p)
select phrase, operators, mentions_12m, age, round(ln(1 + operators) * greatest(0.45 * least(lift, 8.0) + 0.35 * least(yoy_ratio, 8.0) + (case when monotone then 0.6 else 0 end) + (case when list_has_any(string_split(phrase, ' '), ['widget', 'ring']) then 0.3 else 0 end) + 1.5 * (case age when 'unseen_before' then 2.0 when 'recent' then 1.0 else 0.0 end), 0.0) * (1 + 0.15 * coalesce(clinical_pct, 0.0) / 100), 6) as score,
 case when contains(phrase, 'red') then 'already tracked' when mentions_12m < 4 then 'too few mentions' when operators < 6 then 'too few operators' when mentions_12m / operators > 3 then 'a chain' when regions > 0 and regions < 3 then 'one place' when not coalesce(greatest(z_yoy, z_shape) >= 2.4, false) then 'not rising' end as dropped from v""")
def discovery_ladder(spark, sf_dir):
    """Every phrase with its score and the first reason to drop it."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    named = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    anchor = table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("anchor"))
    words = F.array("p_name", F.split("p_name", " ")[0])
    mentions = named.crossJoin(F.broadcast(anchor)).select(F.explode(words).alias("phrase"), dates.bucket(F.col("day"), F.col("anchor")).alias("bucket"), F.col("l_suppkey").alias("op"), F.col("s_nationkey").alias("region"), (F.col("l_returnflag") == "R").alias("context"))
    found = discovery.velocity(discovery.accumulate(mentions))
    return found.select("phrase", "operators", "mentions_12m", "age", F.round(discovery.score(["widget", "ring"]), 6).alias("score"), discovery.judge(F.col("phrase").contains("red")).alias("dropped"))


SEEN = "select o_custkey as domain, o_orderpriority || '/' || o_orderstatus as term, cast(date_trunc('month', o_orderdate) as date) as month from orders"


def seen(spark, sf_dir):
    return orders(spark, sf_dir).select(F.col("o_custkey").alias("domain"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("term"), F.trunc("day", "MM").alias("month"))


@query(f"""with s as ({SEEN}), d as (select domain, min(month) as start from s group by 1), f as (select domain, term, min(month) as first from s group by 1, 2), o as (select f.*, first <= start + interval 3 month as censored from f join d using (domain)), a as (select date '1996-06-01' as a),
c as (select term, count(*) as now, count(*) filter (where censored or first <= a - interval 12 month) as prior, count(*) filter (where censored or first <= a - interval 24 month) as base2, count(*) filter (where censored) as censored, min(first) filter (where not censored) as first_seen from o, a group by 1)
select term, now, prior, censored, cast(first_seen as varchar) as first_seen, now - prior as new_12m, prior - base2 as new_prev_12m, (now - prior) - (prior - base2) as accel, case when prior > 0 then (now - prior) / cast(prior as double) else cast(now - prior as double) end as growth from c""")
def adoption_panel(spark, sf_dir):
    out = panel.adoption(panel.observations(seen(spark, sf_dir)), F.lit("1996-06-01").cast("date"))
    return out.select("term", "now", "prior", "censored", F.col("first_seen").cast("string").alias("first_seen"), "new_12m", "new_prev_12m", "accel", "growth")


@query(f"""with s as ({SEEN}), f as (select term, domain, cast(year(min(month)) as int) as y from s group by 1, 2) select term, cast(yr as int) as year, count(distinct domain) as adopters from f, (select unnest(range(1995, 2002)) as yr) where yr >= y group by 1, 2""")
def cumulative_adopters(spark, sf_dir):
    first = seen(spark, sf_dir).groupBy("term", "domain").agg(F.year(F.min("month")).alias("y"))
    return first.select("term", "domain", F.explode(F.sequence("y", F.lit(2001))).alias("year")).groupBy("term", "year").agg(F.countDistinct("domain").alias("adopters"))


@query("""with t as (select user_id, cast(count(*) filter (where event_type = 'purchase' and value > 60) as bigint) as a, cast(count(*) filter (where event_type = 'purchase' and value <= 60) as bigint) as b, cast(count(*) filter (where event_type <> 'purchase' and value > 60) as bigint) as c, cast(count(*) filter (where event_type <> 'purchase' and value <= 60) as bigint) as d from events group by 1)
select user_id, a, b, c, d, round(list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda i: exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)))), 6) as p from t""")
def fisher_exact(spark, sf_dir):
    """Whether each user's purchases are large more often than their other events."""
    cell = lambda bought, high: F.count_if(((F.col("event_type") == "purchase") == F.lit(bought)) & ((F.col("value") > 60) == F.lit(high)))
    cells = events(spark, sf_dir).groupBy("user_id").agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"))
    return cells.withColumn("p", F.round(stats.fisher_one_sided("a", "b", "c", "d"), 6))


@query("""with n as (select cast(unnest(range(1, 15)) as int) as n) select n, round(power(0.5, n), 6) as sweep_p, power(0.5, n) <= 0.05 / 3 as passes, round(case when n = 1 then 1.0 else (n + 1) * power(0.5, n) end, 6) as one_inversion_p, 6 as needed from n""")
def sweep_power(spark, sf_dir):
    """What a perfect sweep of n signs is worth, and one with a single inversion."""
    rows = spark.range(1, 15).select(F.col("id").cast("int").alias("n"))
    return rows.select("n", F.round(stats.sweep_p("n"), 6).alias("sweep_p"), (stats.sweep_p("n") <= 0.05 / 3).alias("passes"), F.round(stats.binomial_tail(F.col("n") - 1, F.col("n")), 6).alias("one_inversion_p"), F.lit(stats.sweep_needed()).alias("needed"))


@query("""with v as (select user_id, count(*) as n, min(value) as low, max(value) as high from events where event_type = 'purchase' group by 1) select user_id, case when n >= 6 then low end as low, case when n >= 6 then high end as high, case when n >= 6 then round(1 - 2 * power(cast(0.5 as double), n), 4) end as coverage from v""")
def median_interval(spark, sf_dir):
    """The distribution-free interval of each user's median purchase: the widest order statistics; null where even those don't cover it."""
    ends = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.withColumn("ci", stats.median_range("n", "low", "high")).select("user_id", "ci.low", "ci.high", "ci.coverage")


@functools.lru_cache(16)
def _middles(n: int, k: int) -> tuple[np.ndarray, ...]:
    """For every choice of k of n sorted places: the two middle ones of those chosen, and of the rest."""
    few = min(k, n - k)
    one = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), few)), np.int16, math.comb(n, few) * few).reshape(-1, few)
    low, high = one[:, (few - 1) // 2], one[:, few // 2]
    skipped = one - np.arange(few, dtype=np.int16)
    rest = tuple(r + (skipped <= r).sum(1) for r in ((n - few - 1) // 2, (n - few) // 2))
    return (low, high, *rest) if few == k else (*rest, low, high)


def permutation(xs: list[float], ys: list[float], most: int = 200_000) -> float | None:
    """P that a random split of the pool gives a difference of medians at least as large; exact, null if there are too few values or too many splits."""
    if len(xs) < 2 or len(ys) < 2:
        return None
    pool, k = np.sort(np.array(xs + ys, float)), len(xs)
    if math.comb(len(pool), k) > most:
        return None
    a, b, c, d = (pool[at] for at in _middles(len(pool), k))
    found = (a + b) / 2 - (c + d) / 2 >= statistics.median(xs) - statistics.median(ys) - 1e-12
    return int(found.sum()) / len(found)


@query(None)
def permutation_test(spark, sf_dir):
    """Exact permutation test of each user's purchases before and after noon; null where there are too many splits to list."""
    ship(spark)
    rows = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", (F.hour("ts") < 12).alias("early"), "value")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        p = permutation(pdf[pdf.early].value.tolist(), pdf[~pdf.early].value.tolist())
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "p": [p]})

    return rows.groupBy("user_id").applyInPandas(test, "user_id long, p double")


STATE = f"""with {SCORES}, h as (select *, coalesce(g >= ln(1.5) and gt >= ln(1.3) and z >= 3.0 and r >= 12 and count(z) over w = 3 and min(z) over w >= 1.5, false) as hit from z window w as (partition by series order by t rows between 1 following and 3 following)),
k as (select series, min(t) filter (where hit) as onset_t, min(t) filter (where z is not null) as first_t, max(r) as peak, sum(v) as total from h group by 1), y as (select k.*, (select r from h where h.series = k.series and h.t = k.first_t) / nullif((select r from h where h.series = k.series and h.t = k.first_t - 12), 0) as ratio from k)
select series, case when series = '5-LOW' then 'OUT_OF_SCOPE' when total = 0 then 'NO_DATA' when peak < 450 then 'BELOW_FLOOR' when onset_t is not null then 'FIRED' when ratio >= 1.5 then 'ALREADY_BOOMING' else 'NO_ONSET' end as state, onset_t from y"""


@query(STATE.replace("as v from ax", "* (case when row_number() over (partition by ax.series order by ax.month) - 1 >= 56 and ax.series in ('1-URGENT', '2-HIGH') then 4 else 1 end) as v from ax"))
def tier_states(spark, sf_dir):
    """Fired, rejected or abstained: out of scope, below the floor and already booming leave the denominator."""
    rows = injected(spark, sf_dir)
    scored = S.growth_scores(rows)
    found = S.onsets(rows, min_level=C.FLOORS["T2"]).select("series", "onset_t", "total")
    yoy = F.col("r") / F.lag("r", 12).over(S.line())
    first = scored.withColumn("yoy", yoy).groupBy("series").agg(F.max("r").alias("peak"), F.min(F.when(F.col("z").isNotNull(), F.struct("t", "yoy"))).alias("f"))
    state = F.when(F.col("series") == "5-LOW", "OUT_OF_SCOPE").when(F.col("total") == 0, "NO_DATA").when(F.col("peak") < 450, "BELOW_FLOOR").when(F.col("onset_t").isNotNull(), "FIRED").when(F.col("f.yoy") >= C.GROWTH_X, "ALREADY_BOOMING").otherwise("NO_ONSET")
    return found.join(first, "series").select("series", state.alias("state"), "onset_t")


CELL = """case state when 'FIRED' then '**' || onset_t || '**' when 'NO_ONSET' then 'no onset' when 'ALREADY_BOOMING' then '_abstains: already booming_' when 'OUT_OF_SCOPE' then '_abstains: out of scope_' when 'BELOW_FLOOR' then '_abstains: below floor_' else '_no data_' end"""


@query(f"select series, {CELL} as cell from (" + STATE.replace("as v from ax", "* (case when row_number() over (partition by ax.series order by ax.month) - 1 >= 56 and ax.series in ('1-URGENT', '2-HIGH') then 4 else 1 end) as v from ax") + ")")
def state_cells(spark, sf_dir):
    """A tier's state as a report's cell shows it."""
    return tier_states(spark, sf_dir).select("series", stack.cell(F.col("state"), F.col("onset_t")).alias("cell"))


#: By tier: first month, level before the boom, multiple of it after; and the months a boom can start in.
NULL_SHAPES = {"T1": ("2012-01", 5.0, 18.0), "T2": ("2010-01", 6.0, 5.0), "T3": ("2014-01", 3.0, 5.0), "T4": ("2014-01", 4_000.0, 4.0)}
NULL_END, NULL_BOOMS, NULL_RAMP, NULL_SEED = "2026-06", ("2017-01", "2023-01"), 18, 20_260_713


def null_series(spark, reps: int = 200):
    """Series of four tiers that boom in the same month, drawn for each repetition; made where they are used, seeded by the numbers of repetition and tier. T1 is an index of 0 to 100, the others are counts."""

    def make(batches):
        import numpy as np

        number = lambda m: int(m[:4]) * 12 + int(m[5:]) - 1
        low, high = map(number, NULL_BOOMS)
        for pdf in batches:
            for rep in pdf["id"].tolist():
                boom = low + int(np.random.default_rng([NULL_SEED, rep]).integers(0, high - low + 1))
                for k, (tier, (start, base, times)) in enumerate(NULL_SHAPES.items(), 1):
                    t = np.arange(number(NULL_END) - number(start) + 1)
                    level = base * (1 + (times - 1) * np.clip((t + number(start) - boom) / NULL_RAMP, 0, 1))
                    index = np.floor(np.minimum(100.0, level) + (t * 7919 + rep * 13) % 5 / 5.0)
                    v = index if tier == "T1" else np.random.default_rng([NULL_SEED, rep, k]).poisson(level).astype(float)
                    yield pd.DataFrame({"series": f"{rep}/{tier}", "t": t.astype("int32"), "v": v, "start": f"{start}-01", "boom": np.int32(boom)})

    made = spark.range(reps).mapInPandas(make, "series string, t int, v double, start string, boom int")
    return made.select("series", "t", "v", F.add_months(F.col("start").cast("date"), F.col("t")).alias("month"), "boom")


@query(None)
def null_calibration(spark, sf_dir):
    """The apparent lead of each pair of tiers whose true lead is zero: every onset of all repetitions in one query."""
    rep, tier = F.split("series", "/")[0], F.split("series", "/")[1]
    floor = F.element_at(F.create_map(*(F.lit(x) for pair in C.FLOORS.items() for x in pair)), tier)
    found = S.onsets(null_series(spark), min_level=floor).select(rep.alias("rep"), tier.alias("tier"), (F.year("onset") * 12 + F.month("onset")).alias("m"))
    each = found.groupBy("rep").agg(*(F.max(F.when(F.col("tier") == x, F.col("m"))).alias(x) for x in NULL_SHAPES))
    pairs = each.select(F.explode(F.array(*(F.struct(F.lit(f"{x}->{y}").alias("pair"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in itertools.combinations(NULL_SHAPES, 2)))).alias("x")).select("x.*")
    gap = F.col("b") - F.col("a")
    sums = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("reps"), F.count("a").alias("fired_a"), F.count("b").alias("fired_b"), F.count(gap).alias("n"), F.median(gap).alias("median_gap"), F.avg(gap).alias("mean_gap"), F.array_sort(F.collect_list(gap)).alias("gaps"), F.avg((gap > 0).cast("int")).alias("in_order"))
    at = lambda share: F.get("gaps", F.least(F.col("n") - 1, F.floor(F.col("n") * share)).cast("int"))
    return sums.select("pair", "reps", "fired_a", "fired_b", "n", "median_gap", "mean_gap", at(0.1).alias("p10"), at(0.9).alias("p90"), "in_order")


@query("""with c as (select o_orderkey as call, o_custkey as k, cast(o_orderdate as date) as d, case when o_orderkey % 4 = 0 then 'control' else 'pick' end as role from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1999-01-01'),
s as (select o_custkey as k, cast(o_orderdate as date) as d, max(o_totalprice) as v from orders where o_orderstatus <> 'O' group by 1, 2),
n as (select c.call, s.v, row_number() over (partition by c.call order by abs(s.d - (c.d + 365)), s.d) as rn from c join s on c.k = s.k and abs(s.d - (c.d + 365)) <= 45), g as (select role, case when v is null then 'ungradeable' when v >= 250000 then 'hit' else 'miss' end as outcome from c left join n on c.call = n.call and rn = 1)
select role, count(*) as calls, count(*) filter (where outcome = 'hit') as hits, count(*) filter (where outcome = 'ungradeable') as ungradeable from g group by 1""")
def forecast_grades(spark, sf_dir):
    """Calls graded by the snapshot nearest to their maturity; without one they abstain."""
    from tidemark.operators import joins

    rows = orders(spark, sf_dir)
    calls = rows.where("o_orderstatus = 'O' and day < '1999-01-01'").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("k"), F.date_add("day", C.HORIZON_DAYS).alias("d"), F.when(F.col("o_orderkey") % 4 == 0, "control").otherwise("pick").alias("role"))
    shots = rows.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("k"), F.col("day").alias("d"), "o_totalprice")
    near = joins.nearest(calls, shots, ["k"], "d", "o_totalprice", F.lit(C.MATURITY_WINDOW_DAYS))
    outcome = F.when(F.col("near_value").isNull(), "ungradeable").when(F.col("near_value") >= 250_000, "hit").otherwise("miss")
    return near.withColumn("o", outcome).groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("o") == "hit").alias("hits"), F.count_if(F.col("o") == "ungradeable").alias("ungradeable"))


CALLS = """c as (select o_orderkey as call, o_custkey as k, cast(o_orderdate as date) as at, cast(o_orderdate as date) + 365 as matures, cast(least(4, floor(o_totalprice / 100000)) as int) as base from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1999-01-01'),
s as (select o_custkey as k, cast(o_orderdate as date) as day, max(cast(least(4, floor(o_totalprice / 100000)) as int)) as fired from orders where o_orderstatus <> 'O' group by 1, 2),
w as (select c.call, s.day from c join s on s.k = c.k and s.day > c.at and s.day <= c.matures and s.fired > c.base where c.base < 4), f as (select call, min(day) as first from w group by 1),
x as (select w.call, f.first, min(w.day) filter (where w.day >= f.first + 7) as second from w join f using (call) group by 1, 2)"""


def calls_and_snapshots(spark, sf_dir):
    """Open orders as calls, the others of a customer as snapshots, the hundred thousands of the price as tiers that fire."""
    rows = orders(spark, sf_dir).withColumn("tiers", F.least(F.lit(4), F.floor(F.col("o_totalprice") / 100_000)).cast("int"))
    calls = rows.where("o_orderstatus = 'O' and day < '1999-01-01'").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("k"), F.col("day").alias("at"), F.date_add("day", C.HORIZON_DAYS).alias("matures"), F.col("tiers").alias("base"))
    return calls, rows.where("o_orderstatus <> 'O'").groupBy(F.col("o_custkey").alias("k"), "day").agg(F.max("tiers").alias("fired"))


@query(f"""with {CALLS} select call, 1 as nth, cast(first as varchar) as day from x union all select call, 2, cast(second as varchar) from x where second is not null""")
def call_watches(spark, sf_dir):
    """The record of each call's first sighting and of its confirmation at least a week later."""
    return forecasts.watches(forecasts.sightings(*calls_and_snapshots(spark, sf_dir), ["k"])).withColumn("day", F.col("day").cast("string"))


@query(f"""with {CALLS}, n as (select c.call, s.day, s.fired, row_number() over (partition by c.call order by abs(s.day - c.matures), s.day) as rn from c join s on c.k = s.k and abs(s.day - c.matures) <= 45),
e as (select c.call, min(s.day) as day from c join n on n.call = c.call and rn = 1 join s on s.k = c.k and s.day > c.at and s.day <= n.day and s.fired > c.base group by 1),
g as (select c.*, n.day as snapshot, x.first, e.day as shown, case when base >= 4 or (n.day is null and x.second is null) then 'ungradeable' when x.second is not null or n.fired > base then 'hit' else 'miss' end as outcome from c left join n on n.call = c.call and rn = 1 left join x on x.call = c.call left join e on e.call = c.call)
select call, k, cast("at" as varchar) as called, base, cast(snapshot as varchar) as snapshot, outcome, cast(case when outcome = 'hit' then coalesce(first, shown) end as varchar) as evidence, cast(case when outcome = 'hit' then coalesce(first, shown) - "at" end as int) as lead_days from g""")
def call_grades(spark, sf_dir):
    """Every call's outcome, the snapshot it is graded by, and how long its first evidence took."""
    out = forecasts.grade(*calls_and_snapshots(spark, sf_dir), ["k"])
    return out.select("call", "k", F.col("at").cast("string").alias("called"), "base", F.col("snapshot").cast("string").alias("snapshot"), "outcome", F.col("evidence").cast("string").alias("evidence"), "lead_days")


@query("""with q as (select event_type || '/' || user_id as query, event_type as seed, count(*) as sightings, min(ts) as first_ts, max(ts) as last_ts, max(value) as top from events group by 1, 2), l as (select seed, max(last_ts) - interval 3 day as polled from q group by 1)
select query, seed, sightings, epoch_us(first_ts) as first_us, top, last_ts >= polled as current from q join l using (seed) where regexp_matches(query, '[1-9]')""")
def rising_queries(spark, sf_dir):
    """Polled-query memory: a row is current if its last sighting is of its seed's last poll."""
    rows = events(spark, sf_dir).select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("query"), F.col("event_type").alias("seed"), "ts", "value")
    memory = rows.groupBy("query", "seed").agg(F.count(F.lit(1)).alias("sightings"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("value").alias("top"))
    polled = memory.groupBy("seed").agg((F.max("last") - F.expr("interval 3 days")).alias("polled"))
    return memory.join(polled, "seed").where(F.col("query").rlike("[1-9]")).select("query", "seed", "sightings", F.unix_micros("first").alias("first_us"), "top", (F.col("last") >= F.col("polled")).alias("current"))


@query(f"""with s as ({SIGNAL}), g as (select *, {G12} as g12 from s) select p_brand, p_type, case when g12 is null then 'n/a' when g12 >= 0 then '+' || cast(round(g12) as bigint) || '%' else cast(round(g12) as bigint) || '%' end as shown, latest || ' now against ' || prior || ' a year ago' as why from g""")
def digest_lines(spark, sf_dir):
    """Signed percentages and the sentence that gives them their base."""
    rounded = F.round("g12").cast("long")
    shown = F.when(F.col("g12").isNull(), "n/a").when(F.col("g12") >= 0, F.format_string("+%d%%", rounded)).otherwise(F.format_string("%d%%", rounded))
    return signal_rows(spark, sf_dir).select("p_brand", "p_type", shown.alias("shown"), F.format_string("%d now against %d a year ago", "latest", "prior").alias("why"))
