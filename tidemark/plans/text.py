"""Queries: tokens, phrases, taxonomy, names, addresses, URLs and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates
from tidemark.functions import text as X
from tidemark.io import events, table
from tidemark.plans.registry import query

TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+')"
STOP, TAIL = ["the", "and", "of", "is", "to", "small"], ["widget", "gadget", "ring"]


@query(f"""with t as (select doc_id, {TOKENS.format('text')} as ws from documents), g as (select doc_id, unnest(list_distinct(list_concat(list_filter(ws, lambda w: len(w) > 3), list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))) as gram from t)
select gram, count(*) as df from g group by 1 having count(*) >= 60""")
def ngram_df(spark, sf_dir):
    """In how many documents each word and pair of neighbours stands."""
    docs = table(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("ws"))
    grams = F.array_distinct(F.concat(F.filter("ws", lambda w: F.length(w) > 3), X.ngrams(F.col("ws"), 2)))
    return docs.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df >= 60")


QUOTED = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""with n as (select p_partkey, p_brand, {TOKENS.format("p_name || ' ' || lower(p_type)")} as ws from part), w as (select p_partkey, p_brand, ws, list_transform(ws, lambda x: case when len(x) >= 2 and not list_contains({QUOTED(STOP)}, x) then x end) as line from n),
one as (select p_partkey, p_brand, unnest(list_distinct(list_filter(ws, lambda x: len(x) >= 4 and not list_contains({QUOTED(STOP + TAIL)}, x)))) as phrase from w),
two as (select distinct p_partkey, p_brand, line[i] || ' ' || line[i + 1] as phrase from (select *, unnest(range(1, len(line))) as i from w) where line[i] is not null and line[i + 1] is not null and not list_contains({QUOTED(TAIL)}, line[i]) and (len(line[i]) >= 4 or len(line[i + 1]) >= 4)),
three as (select distinct p_partkey, p_brand, line[i] || ' ' || line[i + 1] || ' ' || line[i + 2] as phrase from (select *, unnest(range(1, len(line) - 1)) as i from w) where line[i] is not null and line[i + 1] is not null and line[i + 2] is not null and not list_contains({QUOTED(TAIL)}, line[i]) and (len(line[i]) >= 4 or len(line[i + 1]) >= 4 or len(line[i + 2]) >= 4))
select phrase, count(*) as mentions, count(distinct p_brand) as operators from (select * from one union all select * from two union all select * from three) group by 1""")
def phrase_support(spark, sf_dir):
    """Phrases of one to three words with their mentions and distinct operators."""
    part = table(spark, sf_dir, "part").select("p_brand", X.tokens(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("ws"))
    grams = part.select("p_brand", F.explode(X.phrases(F.col("ws"), stop=STOP, tail=TAIL)).alias("phrase"))
    return grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("p_brand").alias("operators"))


TAXONOMY = [("fasteners", ["bolt", "nut*"]), ("coloured", ["red", "blue widget", "green gear"]), ("machines", ["gear*", "widget", "motor"]), ("large goods", ["large", "big*"])]


def _taxonomy_sql() -> str:
    rows = [(name, order, len(k.rstrip("*")), X.key_pattern(k).replace("\\ ", " ")) for order, (name, ks) in enumerate(TAXONOMY) for k in ks]
    return ", ".join(f"('{n}', {o}, {w}, '{p}')" for n, o, w, p in rows)


@query(f"""with dim(niche, ord, weight, pattern) as (values {_taxonomy_sql()}), names as (select distinct p_name from part)
select p_name, arg_max(niche, (weight, -ord)) as niche from (select p_name, niche, weight, ord from names left join dim on regexp_matches(lower(p_name), pattern)) group by 1""")
def taxonomy_match(spark, sf_dir):
    """The longest key wins: classification as one generated expression on distinct names, not a join."""
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", X.classify(F.col("p_name"), TAXONOMY).alias("niche"))


@query(f"""with dim(niche, ord, weight, pattern) as (values {_taxonomy_sql()}), n as (select p_name, count(*) as n, count(distinct p_brand) as ops from part group by 1) select p_name, n, ops from n where not exists (select 1 from dim where regexp_matches(lower(p_name), pattern))""")
def taxonomy_residue(spark, sf_dir):
    """What no class takes, for discovery."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("ops"))
    return names.where(X.classify(F.col("p_name"), TAXONOMY).isNull())


@query("""with k as (select unnest(['red', 'blue', 'gear']) as key), n as (select distinct p_name, p_brand from part)
select key, count(*) as hits, count(*) filter (where regexp_matches(lower(p_name), '\\b' || key || '\\b')) as exact, round(avg(case when regexp_matches(lower(p_name), '\\b' || key || '\\b') then 1.0 else 0.0 end), 6) as precision from n join k on contains(lower(p_name), key) group by 1""".replace("\\\\", "\\"))
def keyword_precision(spark, sf_dir):
    """Of the names that a key's letters find, how many have it as a word."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), "p_brand").distinct()
    keys = F.array(*(F.when(F.col("name").contains(k), F.struct(F.lit(k).alias("key"), F.col("name").rlike(rf"\b{k}\b").alias("exact"))) for k in ("red", "blue", "gear")))
    hits = names.select(F.explode(F.array_compact(keys)).alias("h"))
    return hits.groupBy(F.col("h.key").alias("key")).agg(F.count(F.lit(1)).alias("hits"), F.count_if("h.exact").alias("exact"), F.round(F.avg(F.col("h.exact").cast("int")), 6).alias("precision"))


NAMES = ["The Alpha & Beta Clinic Limited", "ACME Ltd", "  the Gamma   Co. (UK) Ltd ", "Delta-Care LLP", "Limited", "O'Hara Physio Limited UK"]


def _inline(spark, values: list, ddl: str):
    return spark.createDataFrame(values, ddl)


@query("""with n(name) as (values """ + ", ".join("('" + x.replace("'", "''") + "')" for x in NAMES) + """), a as (select name, trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as x from n),
b as (select name, regexp_replace(x, '^the ', '') as x from a), c as (select name, regexp_replace(regexp_replace(regexp_replace(x, '{0}', ''), '{0}', ''), '{0}', '') as x from b) select name, nullif(trim(x), '') as norm from c""".replace("{0}", X.SUFFIX))
def company_names(spark, sf_dir):
    return _inline(spark, [(n,) for n in NAMES], "name string").select("name", X.company_name(F.col("name")).alias("norm"))


@query("""select c_custkey, case when c_custkey % 5 = 0 then null else upper(left(c_mktsegment, 2)) end as area, case when c_custkey % 7 = 0 and c_custkey % 5 = 0 then null else (case when c_custkey % 5 = 0 then '' else upper(left(c_mktsegment, 2)) || c_nationkey || '1AA' end) || '|' || (case when c_custkey % 7 = 0 then '' else 'unit ' || (c_custkey % 9) || ' mill lane' end) end as key from customer""")
def address_keys(spark, sf_dir):
    """Postcode areas and address keys; null without postcode and street."""
    rows = table(spark, sf_dir, "customer")
    code = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lower(F.substring("c_mktsegment", 1, 2)), F.col("c_nationkey").cast("string"), F.lit(" 1aa")))
    has_street = F.col("c_custkey") % 7 != 0
    premises, street = F.when(has_street, F.concat(F.lit("Unit "), (F.col("c_custkey") % 9).cast("string"))), F.when(has_street, F.lit("Mill-Lane."))
    return rows.select("c_custkey", X.postcode_area(code).alias("area"), X.address_key(code, premises, street).alias("key"))


OFFICERS = [("SMITH, John Andrew", 1961, 4), ("Sarah Jones", 1980, 11), ("O'NEIL, Ann", 1970, 1), ("X, Y", None, 5), ("PATEL, Dr Raj", 1955, None)]


@query("""with o(name, y, m) as (values """ + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {y or 'null'}, {m or 'null'})" for n, y, m in OFFICERS) + """)
select name, case when y is not null and m is not null then case when contains(name, ',') then regexp_replace(lower(trim(split_part(name, ',', 1))), '[^a-z]', '', 'g') || '|' || regexp_replace(split_part(lower(trim(split_part(name, ',', 2))), ' ', 1), '[^a-z]', '', 'g')
 else regexp_replace(lower(regexp_extract(name, '([^ ]+)$', 1)), '[^a-z]', '', 'g') || '|' || regexp_replace(lower(split_part(name, ' ', 1)), '[^a-z]', '', 'g') end || '|' || y || '-' || m end as key, case when 2026 - y - (case when 7 <= coalesce(m, 12) then 1 else 0 end) between 16 and 110 then 2026 - y - (case when 7 <= coalesce(m, 12) then 1 else 0 end) end as age from o""")
def officer_keys(spark, sf_dir):
    rows = _inline(spark, OFFICERS, "name string, y int, m int")
    return rows.select("name", X.officer_key(F.col("name"), F.col("y"), F.col("m")).alias("key"), dates.dob_age(F.col("y"), F.col("m"), F.lit("2026-07-15").cast("date")).alias("age"))


LABELS = ["Breakout", "+4,500%", "120%", "Ausbruch", "", "n/a", "-30 %"]


@query("""with l(label) as (values """ + ", ".join(f"('{x}')" for x in LABELS) + """) select label, lower(trim(label)) in ('breakout', 'ausbruch', 'exponentiel', 'aumento puntual') as is_breakout, case when lower(trim(label)) not in ('breakout', 'ausbruch', 'exponentiel', 'aumento puntual') then try_cast(regexp_replace(label, '[^0-9.\\-]', '', 'g') as double) end as rise from l""")
def rise_labels(spark, sf_dir):
    is_out, rise = X.rise_label(F.col("label"))
    return _inline(spark, [(x,) for x in LABELS], "label string").select("label", is_out.alias("is_breakout"), rise.alias("rise"))


SEEDS = ["the", "near", "me", "cost"]


@query(f"""with d as (select doc_id, {TOKENS.format('text')} as ws from documents) select doc_id, len(list_filter(ws, lambda w: not list_contains({QUOTED(SEEDS)}, w))) = 0 or list_has_any(ws, ['of', 'for']) as junk from d""")
def junk_queries(spark, sf_dir):
    """Phrases with a stop token, or with nothing beyond the seed's tokens."""
    ws = X.tokens(F.col("text"))
    seeds, stops = F.array(*map(F.lit, SEEDS)), F.array(F.lit("of"), F.lit("for"))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.size(F.array_except(ws, seeds)) == 0) | F.arrays_overlap(ws, stops)).alias("junk"))


@query("""with p as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages), d as (select page_id, regexp_replace(host, '^www\\.', '') as host, path from p)
select page_id, case when host <> 'example.org' and not host like '%.example.org' then host end as domain, array_to_string(regexp_extract_all(lower(regexp_replace(path, '\\.(html?|php|aspx?)$', '')), '[a-z0-9]+'), ' ') as words from d""")
def url_terms(spark, sf_dir):
    """Domain without junk hosts, and the words of the path."""
    return table(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url"), ["example.org"]).alias("domain"), F.array_join(X.path_words(F.col("url")), " ").alias("words"))


@query("""with p as (select regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, page_id from pages) select host, count(*) as captures, count(distinct path) as urls, min(page_id) as first_page from p group by 1""")
def archive_index(spark, sf_dir):
    """Captures, distinct URLs and the first capture of each host."""
    host, path = F.try_parse_url("url", F.lit("HOST")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("captures"), F.countDistinct(path).alias("urls"), F.min("page_id").alias("first_page"))


@query("""select page_id, cast(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as int) as links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages""")
def page_links(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("links"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"))


@query("""select event_type, count(*) as n, sum(cast(props ->> '$.k' as bigint)) % 1000 as k from events group by 1""".replace("% 1000", "::bigint % 1000"))
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.sum(k) % 1000).alias("k"))


@query("""with r as (select conv_id, turn, regexp_matches(lower(text), '(the|der|le|el)') and not regexp_matches(lower(text), '(recall|withdrawn)') as ok from conversations), m as (select *, row_number() over (partition by conv_id order by ok desc, turn) as rn from r where ok) select conv_id, turn from m where rn = 1""")
def approval_headlines(spark, sf_dir):
    """Any approving word and no noise word; the first of each thread."""
    low = F.lower("text")
    ok = low.rlike("(the|der|le|el)") & ~low.rlike("(recall|withdrawn)")
    return table(spark, sf_dir, "conversations").where(ok).groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("""with t as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as ws from documents), c as (select doc_id, unnest(list_distinct(ws)) as w, ws from t) select doc_id, count(*) as generic from c where len(w) > 4 and len(list_filter(ws, lambda x: x = w)) >= 2 group by 1""")
def generic_terms(spark, sf_dir):
    """Words that occur at least twice in their text."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("w")).where("length(w) > 4")
    return words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("doc_id").agg(F.count(F.lit(1)).alias("generic"))


@query(f"""with n as (select distinct p_name || ' ' || lower(p_type) as name from part), t as (select name, string_split(name, ' ') as ws from n),
k as (select '* ' || array_to_string(ws[2:], ' ') as skeleton, ws[1] as filler from t union all select array_to_string(ws[:-2], ' ') || ' *', ws[-1] from t) select skeleton, count(*) as names, count(distinct filler) as fillers from k group by 1 having count(distinct filler) >= 4""")
def formulaic_names(spark, sf_dir):
    """Families of names with one slot and at least four fillers."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct()
    slots = names.select(F.explode(X.skeletons(F.split("name", " "))).alias("x")).select("x.skeleton", "x.filler")
    return slots.groupBy("skeleton").agg(F.count(F.lit(1)).alias("names"), F.countDistinct("filler").alias("fillers")).where(F.col("fillers") >= C.FORMULAIC_MIN)


DATES = ["2024-02-29", "31/02/2024", "05-Mar-2021", "07/11/2019", "junk", "2023-13-01", ""]


@query("""with d(raw) as (values """ + ", ".join(f"('{x}')" for x in DATES) + """), p as (select raw, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%d-%b-%Y'), try_strptime(raw, '%d/%m/%Y'))::date as day from d)
select raw, cast(day as varchar) as day, cast(date_trunc('month', day + interval 5 month) as date)::varchar as plus5, cast((2026 * 12 + 7) - (year(day) * 12 + month(day)) as int) as months, cast(greatest(2026 - year(day) - (case when strftime(day, '%m%d') > '0715' then 1 else 0 end), 0) as int) as years, strftime(day, '%G-W%V') as week from p""")
def date_parsing(spark, sf_dir):
    now = F.lit("2026-07-15").cast("date")
    rows = _inline(spark, [(x,) for x in DATES], "raw string").withColumn("d", dates.parse_date(F.col("raw")))
    return rows.select("raw", F.col("d").cast("string").alias("day"), dates.add_months_first(F.col("d"), 5).cast("string").alias("plus5"), dates.months_between(F.col("d"), now).alias("months"), dates.years_between(F.col("d"), now).alias("years"), F.when(F.col("d").isNotNull(), dates.iso_week(F.col("d"))).alias("week"))


@query("""with d as (select distinct cast(o_orderdate as date) as day from orders) select cast(day as varchar) as day, cast(case when day(day) >= 20 then date_trunc('month', day - interval 2 month) else date_trunc('month', day - interval 3 month) end as date)::varchar as published,
 cast(day + interval 6 month as date)::varchar as knowable, cast(date '2001-08-31' - day as int) as age_days, cast(last_day(day) as date)::varchar as month_end from d""")
def publication_dates(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    d = F.col("d")
    return days.select(d.cast("string").alias("day"), dates.latest_published(d).cast("string").alias("published"), dates.knowable_by(d, C.PUBLICATION_LAG["T4"]).cast("string").alias("knowable"), F.datediff(F.lit("2001-08-31").cast("date"), d).alias("age_days"), F.last_day(d).cast("string").alias("month_end"))


@query(f"""with t as (select doc_id, {TOKENS.format('text')} as ws from documents), n as (select doc_id, ws[i - 1] as before, ws[i + 1] as after from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from t) where ws[i] = 'that')
select w as term, count(distinct doc_id) as docs from (select doc_id, before as w from n union all select doc_id, after from n) where w is not null and w <> '' group by 1 having count(distinct doc_id) >= 3""")
def terms_beside(spark, sf_dir):
    """Words that stand next to a head-noun."""
    ws = X.tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ws).alias("i", "w"))
    line = Window.partitionBy("doc_id").orderBy("i")
    near = docs.select("doc_id", "w", F.lag("w").over(line).alias("before"), F.lead("w").over(line).alias("after")).where("w = 'that'")
    both = near.select("doc_id", F.explode(F.array("before", "after")).alias("term")).where("term is not null")
    return both.groupBy("term").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 3")
