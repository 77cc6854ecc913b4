"""Queries: what users call, put together from the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import stats
from tidemark.functions import text as X
from tidemark.io import events, orders, table
from tidemark.operators import components, growth
from tidemark.operators import series as S
from tidemark.operators import structure as M
from tidemark.plans.joins import part_days
from tidemark.plans.registry import query
from tidemark.plans.series import ONSET, SCORES, injected, monthly
from tidemark.shared import fresh
from tidemark.sources import sinks

GRAMS = """select l_orderkey, unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) as term, cast(l_shipdate as date) as d, (select max(cast(l_shipdate as date)) from lineitem) as a from lineitem join part on l_partkey = p_partkey"""


@query(f"""with g as ({GRAMS}), w as (select term, cast(count(*) filter (where d > a - interval 12 month and d <= a) as bigint) as latest, cast(count(*) filter (where d > a - interval 24 month and d <= a - interval 12 month) as bigint) as prior from g group by 1),
c as (select count(*) filter (where d > a - interval 12 month and d <= a) as l, count(*) filter (where d > a - interval 24 month and d <= a - interval 12 month) as p from (select d, a from g))
select term, latest, round(case when prior >= 3 then ((latest / cast(prior as double)) / (l / cast(p as double)) - 1) * 100 end, 6) as net, round(case when prior >= 3 and latest > 0 then (exp(ln(latest / cast(prior as double)) - 1.96 * sqrt(1.0 / latest + 1.0 / prior)) - 1) * 100 end, 6) as low, prior = 0 as is_new from w, c where latest >= 4 order by net desc nulls last, latest desc, term limit 40""")
def incorporations_net(spark, sf_dir):
    """Terms of new names by their growth net of the control group, with support floors and the interval's lower end."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = F.split("p_name", " ")
    terms = lines.select(F.explode(F.array("p_name", words[0], words[1])).alias("term"), F.to_date("l_shipdate").alias("day"))
    counts = growth.window_counts(terms, "term", "day", {"latest": (12, 0), "prior": (24, 12)})
    control = counts.agg(F.sum("latest").alias("l"), F.sum("prior").alias("p"))
    quoted = F.col("prior") >= 3
    net = stats.excess_pct(stats.growth_pct("latest", "prior"), stats.growth_pct("l", "p"))
    rows = counts.where(F.col("latest") >= C.MIN_COUNT).crossJoin(F.broadcast(control))
    out = rows.select("term", "latest", F.round(F.when(quoted, net), 6).alias("net"), F.round(F.when(quoted, stats.ratio_ci("latest", "prior", False)), 6).alias("low"), (F.col("prior") == 0).alias("is_new"))
    return out.orderBy(F.col("net").desc_nulls_last(), F.col("latest").desc(), "term").limit(C.MAX_ROWS)


@query("""with m as (select p_brand as code, (year(l_shipdate) * 12 + month(l_shipdate)) as m, sum(l_quantity) as items from lineitem join part on l_partkey = p_partkey group by 1, 2), t as (select max(m) - 1 as t from m),
r as (select a.code, a.items as latest, b.items as m3, c.items as m12, d.items as m60 from m a join t on a.m = t.t left join m b on b.code = a.code and b.m = a.m - 3 left join m c on c.code = a.code and c.m = a.m - 12 left join m d on d.code = a.code and d.m = a.m - 60)
select code, latest, round((latest / m12 - 1) * 100, 6) as g12, round((latest / m60 - 1) * 100, 6) as g60, round((latest / m3 - 1) * 100 - (latest / m12 - 1) * 100, 6) as accel, round((latest - m12) / sqrt(latest + m12), 6) as z, code in ('Brand#1', 'Brand#2', 'Brand#3') as tracked from r""")
def prescribing_rows(spark, sf_dir):
    """Codes in the newest complete month against 3, 12 and 60 months before; those not tracked are discoveries."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("day", F.to_date("l_shipdate"))
    sums = lines.groupBy(F.col("p_brand").alias("code"), (F.year("day") * 12 + F.month("day")).alias("m")).agg(F.sum("l_quantity").alias("items"))
    line = Window.partitionBy("code").orderBy("m")
    back = {f"m{k}": F.max("items").over(line.rangeBetween(-k, -k)) for k in (3, 12, 60)}
    newest = sums.agg((F.max("m") - 1).alias("t"))
    rows = sums.withColumns(back).crossJoin(F.broadcast(newest)).where("m = t")
    pct = lambda c: stats.growth_pct("items", c)
    return rows.select("code", F.col("items").alias("latest"), F.round(pct("m12"), 6).alias("g12"), F.round(pct("m60"), 6).alias("g60"), F.round(pct("m3") - pct("m12"), 6).alias("accel"), F.round(stats.count_z("items", "m12"), 6).alias("z"), F.col("code").isin("Brand#1", "Brand#2", "Brand#3").alias("tracked"))


REGISTER = [("PL 1/2 Zorvida Lisdex tablets 5 mg for ADHD", "2024-03-01"), ("PL 1/3 Zorvida Lisdex tablets 9 mg for ADHD", "2024-01-15"), ("PL 2/1 Paracet Paracet tablets", "2024-02-01"), ("PL 3/1 Slimora injection for weight", "2023-12-31"), ("PL 3/2 Slimora pen for weight", None), ("note", "2024-01-01")]


@query("""with r(line, day) as (values """ + ", ".join(f"('{a}', {repr(b) if b else 'null'})" for a, b in REGISTER) + """), p as (select regexp_extract(line, '^PL \\d+/\\d+ (\\w+)', 1) as name, regexp_extract(line, '^PL \\d+/\\d+ \\w+ (\\w+)', 1) as second, case when contains(line, 'ADHD') then 'adhd' when contains(line, 'weight') then 'weight loss' end as condition, day from r where line like 'PL %')
select name, condition, min(day) as day, count(*) as strengths from p where name <> second group by 1, 2""".replace("\\\\", "\\"))
def catalysts(spark, sf_dir):
    """Licences out of register lines: generics, whose name says the substance twice, go; strengths collapse to the earliest record."""
    rows = spark.createDataFrame(REGISTER, "line string, day string").where(F.col("line").startswith("PL "))
    part = lambda p: F.regexp_extract("line", p, 1)
    named = rows.select(part(r"^PL \d+/\d+ (\w+)").alias("name"), part(r"^PL \d+/\d+ \w+ (\w+)").alias("second"), X.classify(F.col("line"), [("adhd", ["adhd"]), ("weight loss", ["weight"])]).alias("condition"), "day")
    return named.where("name <> second").groupBy("name", "condition").agg(F.min("day").alias("day"), F.count(F.lit(1)).alias("strengths"))


@query("""with k as (select unnest(['red', 'blue', 'gear', 'ring']) as term), n as (select p_partkey, p_name, case when p_size % 4 = 0 then 'personal' when p_size % 7 = 0 then 'unknown' else 'real' end as label from part), h as (select term, label, p_partkey from n join k on contains(' ' || p_name || ' ', ' ' || term || ' '))
select term, count(*) as raw, count(*) filter (where label = 'real') as real, round(100.0 * count(*) filter (where label = 'unknown') / count(*), 6) as unknown_pct, count(*) filter (where label = 'real') >= 4 as shown from h group by 1""")
def adjusted_counts(spark, sf_dir):
    """Counts of terms once artefacts are taken out, with the share that could not be told."""
    label = F.when(F.col("p_size") % 4 == 0, "personal").when(F.col("p_size") % 7 == 0, "unknown").otherwise("real")
    words = F.split("p_name", " ")
    hits = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.explode(F.array_intersect(words, F.array(*map(F.lit, ("red", "blue", "gear", "ring"))))).alias("term"))
    real, n = F.count_if(F.col("label") == "real"), F.count(F.lit(1))
    return hits.groupBy("term").agg(n.alias("raw"), real.alias("real"), F.round(100.0 * F.count_if(F.col("label") == "unknown") / n, 6).alias("unknown_pct"), (real >= C.MIN_COUNT).alias("shown"))


@query("""with c as (select o_orderkey as id, o_custkey as office, cast(o_orderdate as date) as d, o_orderpriority as name from orders), g as (select office, count(*) as n, count(distinct name) as kinds from c group by 1), l as (select office, d, lead(d, 3) over (partition by office order by d) as later from c), k as (select office, bool_or(coalesce(later - d <= 120, false)) as burst from l group by 1)
select office, n, kinds >= 4 as formulaic, burst, case when n < 2 then 'alone' when n <= 4 then 'linked' when kinds >= 4 and burst then 'batch' else 'agent' end as read from g join k using (office)""")
def spv_clusters(spark, sf_dir):
    """An office that many share is an agent, unless the names are formulaic and the dates cluster: then it is a batch."""
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("office"), "day", F.col("o_orderpriority").alias("name"))
    later = F.lead("day", C.SPV_MIN_CLUSTER - 1).over(Window.partitionBy("office").orderBy("day"))
    near = rows.withColumn("near", F.coalesce(F.datediff(later, F.col("day")) <= C.SPV_WINDOW_DAYS, F.lit(False)))
    sums = near.groupBy("office").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("name") >= C.FORMULAIC_MIN).alias("formulaic"), F.bool_or("near").alias("burst"))
    read = F.when(F.col("n") < 2, "alone").when(F.col("n") <= C.MAX_ADDRESS_GROUP, "linked").when(F.col("formulaic") & F.col("burst"), "batch").otherwise("agent")
    return sums.withColumn("read", read)


@query("""with a as (select max(cast(o_orderdate as date)) as a from orders), f as (select o_custkey as company, count(*) as entries, count(*) filter (where o_orderstatus = 'O') as active, count(*) filter (where o_orderstatus = 'F' and cast(o_orderdate as date) > a - interval 24 month) as resigned_24m, max(case when o_orderstatus = 'P' then cast(o_orderdate as date) end) as charge, min(cast(o_orderdate as date)) as created, any_value(a) as a from orders, a group by 1)
select company, entries, active = 1 as sole, resigned_24m, cast(charge as varchar) as charge_on, coalesce(charge > a - interval 24 month, false) as charge_recent, cast(created as varchar) as created from f""")
def company_facts(spark, sf_dir):
    """Registry facts by company in one pass, with flags of the last 24 months."""
    rows = orders(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("day").alias("a"))))
    recent = F.col("day") > F.add_months("a", -24)
    status = lambda s: F.col("o_orderstatus") == s
    charge = F.max(F.when(status("P"), F.col("day")))
    return rows.groupBy(F.col("o_custkey").alias("company")).agg(F.count(F.lit(1)).alias("entries"), (F.count_if(status("O")) == 1).alias("sole"), F.count_if(status("F") & recent).alias("resigned_24m"), charge.cast("string").alias("charge_on"), F.coalesce(charge > F.add_months(F.max("a"), -24), F.lit(False)).alias("charge_recent"), F.min("day").cast("string").alias("created"))


@query(f"""with {SCORES}, h as (select series, t, z >= 1.0 and g is not null as hit from z), o as (select series, min(t) filter (where hit) as t0 from h group by 1) select a.series as first, b.series as second, b.t0 - a.t0 as gap, b.t0 > a.t0 as in_order from o a join o b on a.series < b.series and a.t0 is not null and b.t0 is not null""")
def lead_times(spark, sf_dir):
    """Gaps between the first unlikely months of each pair of series."""
    found = S.growth_scores(monthly(spark, sf_dir)).where("z >= 1.0 and g is not null").groupBy("series").agg(F.min("t").alias("t0"))
    one, two = found.select(F.col("series").alias("first"), F.col("t0").alias("a")), found.select(F.col("series").alias("second"), F.col("t0").alias("b"))
    return one.join(two, F.col("first") < F.col("second")).select("first", "second", (F.col("b") - F.col("a")).alias("gap"), (F.col("b") > F.col("a")).alias("in_order"))


BOOMS = ("with " + ONSET).replace("as v from ax", "* (case when row_number() over (partition by ax.series order by ax.month) - 1 >= 56 and ax.series in ('1-URGENT', '2-HIGH') then 4 else 1 end) as v from ax")
SENSITIVITY = (1.25, 1.5, 2.0)


@query("with o as (" + " union all ".join(f"select cast({x} as double) as growth_x, series, onset_t from ({BOOMS.format(x=x, z=3.0, k=1.5)})" for x in SENSITIVITY) + """)
select growth_x, a.series as first, b.series as second, a.onset_t as first_t, b.onset_t as second_t, b.onset_t - a.onset_t as gap, b.onset_t > a.onset_t as in_order from o a join o b using (growth_x) where a.series < b.series and a.onset_t is not null and b.onset_t is not null""")
def lead_time_sensitivity(spark, sf_dir):
    """Gaps between the onsets of each pair of series, for each growth that an onset may be asked to show."""
    rows = injected(spark, sf_dir)
    found = [S.onsets(rows, min_level=C.FLOORS["T2"], growth_x=x).where("onset_t is not null").select(F.lit(x).alias("growth_x"), "series", "onset_t") for x in SENSITIVITY]
    each = found[0].union(found[1]).union(found[2])
    one, two = (each.select("growth_x", F.col("series").alias(c), F.col("onset_t").alias(f"{c}_t")) for c in ("first", "second"))
    pairs = one.join(two, "growth_x").where(F.col("first") < F.col("second"))
    return pairs.select("growth_x", "first", "second", "first_t", "second_t", (F.col("second_t") - F.col("first_t")).alias("gap"), (F.col("second_t") > F.col("first_t")).alias("in_order"))


@query("""with c as (select o_orderpriority as k, cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n from orders where month(o_orderdate) <> 3 or o_orderpriority = '5-LOW' group by 1, 2), s as (select cast((year(max(o_orderdate)) * 12 + month(max(o_orderdate))) - (year(min(o_orderdate)) * 12 + month(min(o_orderdate))) + 1 as bigint) as months from orders)
select k, count(*) as cells, months, round(100.0 * count(*) / months, 6) as covered_pct, count(*) / cast(months as double) >= 0.95 as usable from c, s group by k, months""")
def completeness(spark, sf_dir):
    """How many of a series' months are there; thin series are withheld."""
    rows = orders(spark, sf_dir)
    number = lambda c: F.year(c) * 12 + F.month(c)
    span = rows.agg((number(F.max("day")) - number(F.min("day")) + 1).cast("long").alias("months"))
    cells = rows.where((F.month("day") != 3) | (F.col("o_orderpriority") == "5-LOW")).groupBy(F.col("o_orderpriority").alias("k")).agg(F.countDistinct(F.trunc("day", "MM")).alias("cells"))
    return cells.crossJoin(F.broadcast(span)).select("k", "cells", "months", F.round(100.0 * F.col("cells") / F.col("months"), 6).alias("covered_pct"), (F.col("cells") / F.col("months") >= 0.95).alias("usable"))


OWNERS = """with recursive m as (select distinct l_suppkey as node, l_partkey || '|' || cast(l_shipdate as date) as key from lineitem), g as (select key, count(*) as n, min(node) as first from m group by 1), e as (select distinct first as u, node as v from m join g using (key) where n between 2 and 4 and node <> first), b as (select u, v from e union select v, u from e),
r(node, c) as (select node, node from (select distinct node from m) union select r.node, b.v from r join b on b.u = r.c), o as (select node, min(c) as owner from r group by 1), l as (select p_type as niche, l_suppkey as unit, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


@query(f"""{OWNERS}, legal as (select niche, sum(n) as total, count(*) as units, sum(n * cast(n as double)) as squares from l group by 1), econ as (select niche, count(*) as owners, sum(n * cast(n as double)) as squares from (select niche, coalesce(owner, unit) as owner, sum(n) as n from l left join o on l.unit = o.node group by 1, 2) group by 1)
select niche, units, owners, units - owners as hidden, round(legal.squares / total / total, 6) as legal_hhi, round(econ.squares / total / total, 6) as economic_hhi from legal join econ using (niche)""")
def economic_owners(spark, sf_dir):
    """Concentration by legal entity and by economic owner: what sharing a key hides."""
    lines = table(spark, sf_dir, "lineitem")
    kept, _ = components.shared_key_edges(part_days(spark, sf_dir), "node", "key", C.MAX_ADDRESS_GROUP)
    owners = components.components(kept)
    units = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("niche"), F.col("l_suppkey").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    owned = units.join(owners, units.unit == owners.node, "left").groupBy("niche", F.coalesce("component", "unit").alias("owner")).agg(F.sum("n").alias("n"))
    squares = F.sum(F.col("n").cast("double") * F.col("n"))
    legal = units.groupBy("niche").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("units"), squares.alias("ls"))
    econ = owned.groupBy("niche").agg(F.count(F.lit(1)).alias("owners"), squares.alias("es"))
    share = lambda c: F.round(F.col(c) / F.col("total") / F.col("total"), 6)
    return legal.join(econ, "niche").select("niche", "units", "owners", (F.col("units") - F.col("owners")).alias("hidden"), share("ls").alias("legal_hhi"), share("es").alias("economic_hhi"))


@query("""with s as (select c_custkey, c_mktsegment as niche, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_name) as place from customer where c_acctbal > 0) select niche, cast(place as int) as place, c_custkey from s where place <= 8""")
def call_list(spark, sf_dir):
    """The best sellers of each niche, capped, written as CSV and read back."""
    ranked = table(spark, sf_dir, "customer").where("c_acctbal > 0").withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_name")))
    path = fresh(spark, "calls")
    sinks.call_list(ranked.where("place <= 8").select(F.col("c_mktsegment").alias("niche"), "place", "c_custkey"), path)
    return spark.read.schema("niche string, place int, c_custkey long").option("header", True).csv(path)


@query("""select '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' as json from nation""")
def json_rows(spark, sf_dir):
    return sinks.json_rows(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))


@query("""select '| ' || r_regionkey || ' | ' || r_name || ' |' as line from region union all select unnest(['# Regions', '', '| key | name |', '|-|-|'])""")
def markdown_report(spark, sf_dir):
    return sinks.markdown(table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "Regions")


@query("""select cast(date_trunc('month', o_orderdate) as date)::varchar as month, count(*) as n from orders group by 1""")
def immutable_months(spark, sf_dir):
    """Months are written once: a later sweep adds those that are missing and changes none."""
    rows = orders(spark, sf_dir).withColumn("month", F.trunc("day", "MM").cast("string"))
    path = fresh(spark, "months")
    counts = lambda cond: rows.where(cond).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    sinks.append_missing(counts("day < '1998-01-01'"), path, "month", None)
    sinks.append_missing(counts("true"), path, "month", spark.read.schema("n long, month string").parquet(path))
    return spark.read.schema("n long, month string").parquet(path).select("month", "n")


@query("""with l as (select user_id as key, max(ts) as tried, arg_max(event_type, ts) as outcome from events group by 1), t as (select max(ts) as now from events) select key, outcome, case when outcome = 'error' then tried + interval 7 day <= now else false end as retry from l, t""")
def tombstones(spark, sf_dir):
    """What failed last is not asked again for seven days; answers are kept."""
    rows = events(spark, sf_dir)
    last = rows.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("tried"), F.max_by("event_type", "ts").alias("outcome"))
    both = last.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))
    return both.select("key", "outcome", ((F.col("outcome") == "error") & (F.col("tried") + F.expr("interval 7 days") <= F.col("now"))).alias("retry"))


@query("""with d(demand, supply) as (select * from (values ('growing'), ('booming'), ('falling'), ('flat')) a(demand), (values ('unknown'), ('none'), ('consolidated'), ('filling'), ('fragmented')) b(supply))
select demand, supply, case when supply = 'unknown' then 'no_data' when supply = 'consolidated' then 'too_late' when supply = 'none' then case when demand in ('growing', 'booming') then 'build_only' else 'nothing_here' end when supply = 'filling' then 'wait_or_build' when demand = 'falling' then 'declining' else 'buy_window' end as quadrant from d""")
def buyer_quadrants(spark, sf_dir):
    """Every pair of reads with the quadrant it leads to."""
    reads = spark.createDataFrame([(d, s) for d in ("growing", "booming", "falling", "flat") for s in ("unknown", "none", "consolidated", "filling", "fragmented")], "demand string, supply string")
    return reads.withColumn("quadrant", M.quadrant(F.col("demand"), F.col("supply")))
