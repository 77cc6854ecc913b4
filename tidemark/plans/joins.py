"""Queries: joins, set operations and the ownership graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X
from tidemark.io import events, orders, table
from tidemark.operators import components, discovery, joins
from tidemark.plans.registry import query


@query("""select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA'""")
def sector_join(spark, sf_dir):
    """Locations with their sector: both dimensions are broadcast, by their size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    named = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return table(spark, sf_dir, "supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


YEARS = "cast(year(o_orderdate) as int)"


@query(f"""with n as (select o_custkey as k, count(*) filter (where {YEARS} = 2000) as now, count(*) filter (where {YEARS} = 1996) as before from orders group by 1)
select k, cast(now as bigint) as now, case when before > 0 then cast(before as bigint) end as before from n where now > 0""")
def prior_period(spark, sf_dir):
    """Current against prior period by key in one pass; a missing prior period is null."""
    year = F.year("day")
    counts = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(year == 2000).alias("now"), F.count_if(year == 1996).alias("n"))
    return counts.where("now > 0").select("k", "now", F.when(F.col("n") > 0, F.col("n")).alias("before"))


@query(f"""with a as (select o_custkey as k, count(*) as now from orders where {YEARS} = 2001 group by 1), b as (select o_custkey as k, count(*) as before from orders where {YEARS} = 1995 group by 1)
select coalesce(a.k, b.k) as k, now, before, case when now is null then 'gone' when before is null then 'new' when now > before then 'up' when now < before then 'down' else 'same' end as move from a full join b on a.k = b.k""")
def full_outer_moves(spark, sf_dir):
    year = lambda y, name: orders(spark, sf_dir).where(F.year("day") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))
    both = year(2001, "now").join(year(1995, "before"), "k", "full")
    move = F.when(F.col("now").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.col("now") > F.col("before"), "up").when(F.col("now") < F.col("before"), "down").otherwise("same")
    return both.select("k", "now", "before", move.alias("move"))


@query(f"select distinct o_custkey as k from orders a where {YEARS} = 2001 and not exists (select 1 from orders b where b.o_custkey = a.o_custkey and {YEARS.replace('o_orderdate', 'b.o_orderdate')} < 2000)")
def anti_new_keys(spark, sf_dir):
    rows = orders(spark, sf_dir).select("o_custkey", F.year("day").alias("year"))
    return rows.where("year = 2001").select(F.col("o_custkey").alias("k")).distinct().join(rows.where("year < 2000").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("""with want as (select unnest(generate_series(date '2001-01-01', date '2002-06-01', interval 1 month)) as month), have as (select distinct date_trunc('month', o_orderdate) as month from orders)
select cast(w.month as date) as month, h.month is not null as present from want w left join have h on w.month = h.month""", days=("month",))
def wanted_months(spark, sf_dir):
    """The months that are wanted, and whether their partition is there."""
    have = orders(spark, sf_dir).select(F.trunc("day", "MM").alias("month"), F.lit(True).alias("present")).distinct()
    want = spark.sql("select explode(sequence(date '2001-01-01', date '2002-06-01', interval 1 month)) as month")
    return want.join(have, "month", "left").select("month", F.coalesce("present", F.lit(False)).alias("present"))


@query("""select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_discount > 0.09 and l_quantity > 48)""")
def semi_present(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_discount > 0.09 and l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(seen, "s_suppkey", "left_semi")


def _clicks(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), rows.where("event_type = 'click'").select("user_id", "ts", "value", "event_id")


@query("""with p as (select event_id, user_id, ts from events where event_type = 'purchase'), c as (select user_id, ts, value, event_id as click_id from events where event_type = 'click')
select p.event_id, p.user_id, c.value as asof_value from p asof left join c on p.user_id = c.user_id and p.ts >= c.ts""")
def asof_backward(spark, sf_dir):
    left, right = _clicks(spark, sf_dir)
    return joins.asof(left, right.drop("event_id"), ["user_id"], "ts", ["value"]).select("event_id", "user_id", "asof_value")


@query("""with a as (select o_custkey as k, cast(o_orderdate as date) as d, min(o_orderkey) as id from orders where o_orderpriority = '1-URGENT' group by 1, 2),
b as (select o_custkey as k, cast(o_orderdate as date) as d, max(o_totalprice) as v from orders where o_orderpriority = '2-HIGH' group by 1, 2),
j as (select a.id, a.k, a.d, b.d as near_at, b.v as near_value, row_number() over (partition by a.id order by abs(b.d - a.d), b.d) as rn from a join b on a.k = b.k and abs(b.d - a.d) <= 45)
select a.id, cast(j.near_at as varchar) as near_at, j.near_value from a left join j on a.id = j.id and rn = 1""")
def asof_nearest(spark, sf_dir):
    """The nearest snapshot within 45 days; of two as near, the earlier."""
    rows = orders(spark, sf_dir).withColumnRenamed("o_custkey", "k").withColumnRenamed("day", "d")
    left = rows.where("o_orderpriority = '1-URGENT'").groupBy("k", "d").agg(F.min("o_orderkey").alias("id"))
    near = joins.nearest(left, rows.where("o_orderpriority = '2-HIGH'").select("k", "d", "o_totalprice"), ["k"], "d", "o_totalprice", F.lit(C.MATURITY_WINDOW_DAYS))
    return near.select("id", F.col("near_at").cast("string").alias("near_at"), "near_value")


@query("""with c as (select o_custkey as k, o_orderkey as call, cast(o_orderdate as date) as d from orders where o_orderstatus = 'P'), w as (select o_custkey as k, o_orderkey as watch, cast(o_orderdate as date) as d from orders where o_orderstatus = 'F')
select call, count(*) as sightings, cast(min(w.d) as varchar) as first_seen, cast(max(w.d) - min(w.d) as int) >= 7 as confirmed from c join w on c.k = w.k and w.d > c.d and w.d <= c.d + 365 group by 1""")
def interval_join(spark, sf_dir):
    """Sightings within a year after each call; two that are a week apart confirm it."""
    rows = orders(spark, sf_dir)
    calls = rows.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("call"), F.col("day").alias("a"), F.date_add("day", C.HORIZON_DAYS).alias("b"))
    seen = rows.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("day").alias("d"))
    hits = joins.in_interval(seen, calls, ["k"], "d", "a", "b", 365)
    return hits.groupBy("call").agg(F.count(F.lit(1)).alias("sightings"), F.min("d").cast("string").alias("first_seen"), (F.datediff(F.max("d"), F.min("d")) >= C.CONFIRM_GAP_DAYS).alias("confirmed"))


@query("""with c as (select c_custkey, c_nationkey, regexp_extract(c_name, '#0*([0-9]+)$', 1) as norm from customer), s as (select s_suppkey, s_nationkey, regexp_extract(s_name, '#0*([0-9]+)$', 1) as norm from supplier union all select s_suppkey + 1000, s_nationkey, regexp_extract(s_name, '#0*([0-9]+)$', 1) from supplier where s_suppkey % 10 = 3),
n as (select norm, count(*) as n, min(s_suppkey) as s, min(s_nationkey) as nat from s group by 1)
select c_custkey, case when n is null then 'unmatched' when n > 1 then 'ambiguous' else 'matched' end as status, case when n = 1 then s end as matched, case when n = 1 then case when nat = c_nationkey then 'high' else 'name-only' end end as confidence from c left join n using (norm)""")
def entity_match(spark, sf_dir):
    """Exact normalised names: several candidates are ambiguous and keep no number; an equal area raises the confidence."""
    number = lambda c: F.regexp_extract(c, "#0*([0-9]+)$", 1)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", number("s_name").alias("norm"))
    twice = supplier.unionByName(supplier.where("s_suppkey % 10 = 3").withColumn("s_suppkey", F.col("s_suppkey") + 1000))
    found = twice.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("s"), F.min("s_nationkey").alias("nat"))
    rows = table(spark, sf_dir, "customer").withColumn("norm", number("c_name")).join(found, "norm", "left")
    one = F.col("n") == 1
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return rows.select("c_custkey", status.alias("status"), F.when(one, F.col("s")).alias("matched"), F.when(one, F.when(F.col("nat") == F.col("c_nationkey"), "high").otherwise("name-only")).alias("confidence"))


PHRASES = """select distinct unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) as phrase, l_suppkey as op from lineitem join part on l_partkey = p_partkey"""


def phrase_operators(spark, sf_dir):
    """(phrase, op): the operators that use each phrase."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = F.split("p_name", " ")
    return lines.select(F.explode(F.array("p_name", words[0], words[1])).alias("phrase"), F.col("l_suppkey").alias("op")).distinct()


@query(f"""with p as ({PHRASES}), s as (select phrase, count(*) as n from p group by 1),
o as (select a.phrase as short, b.phrase as long, count(*) as common from p a join p b on a.op = b.op and a.phrase <> b.phrase and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') group by 1, 2)
select short, long, common, common >= 0.5 * least(x.n, y.n) as same_family from o join s x on x.phrase = short join s y on y.phrase = long""")
def same_family(spark, sf_dir):
    """Phrases one of which contains the other, and whether half of the operators of the smaller use both. The pairs
    come from a join on the operator, not from all pairs of phrases."""
    uses = phrase_operators(spark, sf_dir)
    sizes = uses.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    longer = uses.where(F.col("phrase").contains(" "))
    pairs = longer.select(F.col("phrase").alias("long"), "op", F.explode(F.split("phrase", " ")).alias("short")).where("short <> long").distinct()
    common = pairs.join(uses.select(F.col("phrase").alias("short"), "op"), ["short", "op"]).groupBy("short", "long").agg(F.count(F.lit(1)).alias("common"))
    named = lambda c: sizes.select(F.col("phrase").alias(c), F.col("n").alias(f"n_{c}"))
    return common.join(named("short"), "short").join(named("long"), "long").select("short", "long", "common", (F.col("common") >= 0.5 * F.least("n_short", "n_long")).alias("same_family"))


@query(f"""with recursive p as ({PHRASES}), s as (select phrase, count(*) as n, len(string_split(phrase, ' ')) as words from p group by 1),
o as (select a.phrase as short, b.phrase as long, count(*) as common from p a join p b on a.op = b.op and a.phrase <> b.phrase and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') group by 1, 2),
f as (select short, long from o join s x on x.phrase = short join s y on y.phrase = long where common >= 0.95 * least(x.n, y.n) and common >= 0.5 * greatest(x.n, y.n)), l as (select short as a, long as b from f union select long, short from f),
r(phrase, root) as (select phrase, phrase from s union select l.b, r.root from r join l on l.a = r.phrase), m as (select phrase, min(root) as fam from r group by 1), k as (select m.fam, s.* from m join s using (phrase)),
best as (select *, row_number() over (partition by fam order by n desc, phrase) as rn from k),
longer as (select k.fam, k.phrase, row_number() over (partition by k.fam order by k.words desc, k.n desc, k.phrase) as rn from k join best b on b.fam = k.fam and b.rn = 1 where k.words > b.words and contains(' ' || k.phrase || ' ', ' ' || b.phrase || ' ') and k.n >= 0.8 * b.n)
select k.phrase, coalesce(g.phrase, b.phrase) as representative, b.n as family_score from k join best b on b.fam = k.fam and b.rn = 1 left join longer g on g.fam = k.fam and g.rn = 1""")
def phrase_families(spark, sf_dir):
    """Phrases that contain one another and have nearly the same operators are one discovery, under the name that most of them use."""
    uses = phrase_operators(spark, sf_dir)
    sizes = uses.groupBy("phrase").agg(F.count(F.lit(1)).alias("operators"))
    pairs = sizes.select(F.col("phrase").alias("long"), F.col("operators").alias("n_long"), F.explode(X.runs(F.split("phrase", " "))).alias("short")).where("short <> long")
    pairs = pairs.join(sizes.select(F.col("phrase").alias("short"), F.col("operators").alias("n_short")), "short")
    both = pairs.join(uses.select(F.col("phrase").alias("long"), "op"), "long").join(uses.select(F.col("phrase").alias("short"), "op"), ["short", "op"])
    common = both.groupBy("short", "long", "n_short", "n_long").agg(F.count(F.lit(1)).alias("common"))
    alike = (F.col("common") >= 0.95 * F.least("n_short", "n_long")) & (F.col("common") >= 0.5 * F.greatest("n_short", "n_long"))
    links = common.where(alike).select(F.col("short").alias("u"), F.col("long").alias("v"))
    return discovery.collapse(sizes.withColumn("score", F.col("operators")), links)


@query(f"""with p as (select phrase, op from ({PHRASES})), s as (select phrase, list_sort(list(op)) as ops from p group by 1)
select a.phrase as short, b.phrase as long, cast(len(a.ops) as int) as adopters from s a join s b on a.ops = b.ops and a.phrase <> b.phrase and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')""")
def subsumed_terms(spark, sf_dir):
    """Terms that a longer one with the same adopters explains: runs of the longer one's words that as many use, and then the same ones."""
    uses = phrase_operators(spark, sf_dir)
    sizes = uses.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.select(F.col("phrase").alias("long"), "n", F.explode(X.runs(F.split("phrase", " "))).alias("short")).where("short <> long")
    even = pairs.join(sizes.select(F.col("phrase").alias("short"), "n"), ["short", "n"])
    both = even.join(uses.select(F.col("phrase").alias("long"), "op"), "long").join(uses.select(F.col("phrase").alias("short"), "op"), ["short", "op"])
    return both.groupBy("short", "long", "n").agg(F.count(F.lit(1)).alias("common")).where("common = n").select("short", "long", F.col("n").cast("int").alias("adopters"))


@query("""with r as (select p_type as phrase, 'observed' as evidence, count(distinct p_brand) as operators, count(*) as mentions from part where p_size <= 25 group by 1 union all select p_type, 'assumed', count(distinct p_partkey), count(*) from part where p_size > 25 group by 1)
select phrase, arg_max(evidence, (evidence = 'observed', operators)) as evidence, arg_max(operators, (evidence = 'observed', operators)) as operators, count(*) as sources from r group by 1""")
def tier_merge(spark, sf_dir):
    """The best evidence stands; counts of tiers are never summed."""
    part = table(spark, sf_dir, "part")
    tier = lambda rows, kind, op: rows.groupBy(F.col("p_type").alias("phrase")).agg(F.countDistinct(op).alias("operators")).withColumn("evidence", F.lit(kind))
    both = tier(part.where("p_size <= 25"), "observed", "p_brand").unionByName(tier(part.where("p_size > 25"), "assumed", "p_partkey"))
    best = F.struct((F.col("evidence") == "observed").alias("seen"), "operators", "evidence")
    return both.groupBy("phrase").agg(F.max(best).alias("b"), F.count(F.lit(1)).alias("sources")).select("phrase", "b.evidence", "b.operators", "sources")


CODES = [("1-URGENT", "acute"), ("2-HIGH", "acute"), ("5-LOW", "routine")]


@query(f"""with dim(code, niche) as (values {', '.join(map(str, CODES))}) select niche, count(*) as items, round(sum(o_totalprice), 2) as value from orders join dim on code = o_orderpriority group by 1""")
def code_niche_join(spark, sf_dir):
    dim = F.broadcast(spark.createDataFrame(CODES, "code string, niche string"))
    return orders(spark, sf_dir).join(dim, F.col("o_orderpriority") == F.col("code")).groupBy("niche").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("o_totalprice"), 2).alias("value"))


def part_days(spark, sf_dir):
    """Suppliers as nodes, and the parts that they ship on a day as keys."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.concat_ws("|", "l_partkey", F.to_date("l_shipdate")).alias("key"))


SHARED = """with recursive m as (select distinct l_suppkey as node, l_partkey || '|' || cast(l_shipdate as date) as key from lineitem),
g as (select key, count(*) as n, min(node) as first from m group by 1), e as (select distinct first as u, node as v from m join g using (key) where n between 2 and 4 and node <> first),
b as (select u, v from e union select v, u from e), r(node, c) as (select node, node from (select distinct node from m) union select r.node, b.v from r join b on b.u = r.c)"""


@query(f"{SHARED} select node, min(c) as owner, count(*) as reached from r group by 1")
def components_shared_key(spark, sf_dir):
    """Owners: nodes that share a key are one, unless the key is a hub."""
    members = part_days(spark, sf_dir)
    edges, _ = components.shared_key_edges(members, "node", "key", C.MAX_ADDRESS_GROUP)
    found = components.components(edges)
    placed = members.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("owner"))
    return placed.join(placed.groupBy("owner").agg(F.count(F.lit(1)).alias("reached")), "owner").select("node", "owner", "reached")


@query("""with m as (select distinct l_suppkey as node, l_partkey as key from lineitem) select key, count(*) as n from m group by 1 having count(*) > 4""")
def hubs_ignored(spark, sf_dir):
    """Keys that too many share are reported, not linked."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("key"))
    return components.shared_key_edges(members, "node", "key", C.MAX_ADDRESS_GROUP)[1]


@query("""select event_id, 'a' as src from events where event_type = 'error' and value > 90 union all select event_id, 'b' from events where value > 95""")
def union_rows(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.where("event_type = 'error' and value > 90").select("event_id", F.lit("a").alias("src")).unionByName(rows.where("value > 95").select("event_id", F.lit("b").alias("src")))


@query("""select name, count(*) as sources from (select distinct n_name as name, 1 as s from nation join customer on c_nationkey = n_nationkey union select distinct r_name, 2 from region union select n_name, 3 from nation join supplier on s_nationkey = n_nationkey) group by 1""")
def union_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    part = lambda rows, c, s: rows.select(F.col(c).alias("name"), F.lit(s).alias("s"))
    of = lambda t, k: part(nation.join(table(spark, sf_dir, t).select(F.col(k).alias("n_nationkey")), "n_nationkey", "left_semi"), "n_name", 1 if t == "customer" else 3)
    return of("customer", "c_nationkey").union(part(table(spark, sf_dir, "region"), "r_name", 2)).union(of("supplier", "s_nationkey")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("sources"))


@query("""with s as (select p_brand, list(distinct p_type) as t from part where p_size < 6 group by 1), b as (select p_brand, list(distinct p_type) as t from part where p_size >= 46 group by 1)
select p_brand, array_to_string(list_sort(list_intersect(s.t, b.t)), ',') as both_sizes, array_to_string(list_sort(list_filter(s.t, lambda x: not list_contains(b.t, x))), ',') as small_only from s join b using (p_brand)""")
def set_intersect_except(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sets = part.groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") < 6, F.col("p_type"))).alias("s"), F.collect_set(F.when(F.col("p_size") >= 46, F.col("p_type"))).alias("b"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return sets.where("size(s) > 0 and size(b) > 0").select("p_brand", joined(F.array_intersect("s", "b")).alias("both_sizes"), joined(F.array_except("s", "b")).alias("small_only"))


@query("""with r as (select lower(event_type) as name, user_id % 7 as condition, case when value < 5 then null else ts end as ts, event_id from events)
select name, condition, epoch_us(min(ts)) as first_us, arg_min(event_id, (coalesce(epoch_us(ts), 9223372036854775807), event_id)) as event_id from r group by 1, 2""")
def merge_keep_earliest(spark, sf_dir):
    """One record for each name and condition, the earliest; unknown dates sort last."""
    rows = events(spark, sf_dir).select(F.lower("event_type").alias("name"), (F.col("user_id") % 7).alias("condition"), F.when(F.col("value") >= 5, F.unix_micros("ts")).alias("us"), "event_id")
    order = F.struct(F.coalesce("us", F.lit(9223372036854775807)).alias("a"), F.col("event_id").alias("b"))
    return rows.groupBy("name", "condition").agg(F.min("us").alias("first_us"), F.min_by("event_id", order).alias("event_id"))


@query("""with old as (select user_id, min(ts) as first_ts, max(value) as top, count(*) as n from events where ts < timestamp '2024-01-16' group by 1), new as (select user_id, min(ts) as first_ts, max(value) as top, count(*) as n from events where ts >= timestamp '2024-01-16' group by 1)
select coalesce(o.user_id, n.user_id) as user_id, epoch_us(coalesce(o.first_ts, n.first_ts)) as first_us, greatest(coalesce(o.top, n.top), coalesce(n.top, o.top)) as top, cast(coalesce(o.n, 0) + coalesce(n.n, 0) as bigint) as sightings from old o full join new n on o.user_id = n.user_id""")
def upsert_memory(spark, sf_dir):
    """A harvest merged into memory: first seen never changes, ranks take the maximum, sightings add up."""
    rows = events(spark, sf_dir)
    side = lambda cond, s: rows.where(cond).groupBy("user_id").agg(F.min("ts").alias(f"first_{s}"), F.max("value").alias(f"top_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    both = side("ts < '2024-01-16'", "o").join(side("ts >= '2024-01-16'", "n"), "user_id", "full")
    return both.select("user_id", F.unix_micros(F.coalesce("first_o", "first_n")).alias("first_us"), F.greatest("top_o", "top_n").alias("top"), (F.coalesce("n_o", F.lit(0)) + F.coalesce("n_n", F.lit(0))).alias("sightings"))


@query(f"""with a as (select o_custkey as k, cast(date_trunc('month', o_orderdate) as date) as m, o_orderstatus as s from orders)
select cast(year(m) as int) as year, count(distinct (k, m)) filter (where s <> 'F') as active, count(distinct (k, m)) as ever from a group by 1""")
def survivorship(spark, sf_dir):
    """The series of those still active, and of all that ever were."""
    rows = orders(spark, sf_dir).select("o_custkey", F.trunc("day", "MM").alias("m"), "o_orderstatus")
    return rows.groupBy(F.year("m").alias("year")).agg(F.countDistinct(F.when(F.col("o_orderstatus") != "F", F.struct("o_custkey", "m"))).alias("active"), F.countDistinct(F.struct("o_custkey", "m")).alias("ever"))
