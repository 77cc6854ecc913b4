"""Queries: streaming flows, landed sources and spreadsheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.io import table
from tidemark.plans.registry import query
from tidemark.shared import fresh
from tidemark.sources import landed, ods
from tidemark.streaming import flows


def stream(spark, sf_dir, batches: int | None = None):
    """The events, landed as many files, as a stream. What needs the order of time takes them in one batch, so that no file makes another late."""
    rows = table(spark, sf_dir, "events")
    path = fresh(spark, "landed")
    rows.repartition(batches or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.parquet(path)
    return flows.source(spark, path, rows.schema, max_files=1 if batches else 1_000_000).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with w as (select time_bucket(interval 7 day, ts, timestamp '1970-01-01') as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2), m as (select max(ts) - interval 1 day as mark from events)
select epoch_us(start) as start_us, event_type, n, round(total, 4) as total from w, m where start + interval 7 day <= mark""")
def stream_tumbling(spark, sf_dir):
    """Weekly counts that the watermark has closed."""
    out = flows.run(flows.tumbling(stream(spark, sf_dir), "event_type"))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select user_id, event_type, epoch_us(min(ts)) as first_us from events group by 1, 2""")
def stream_memory(spark, sf_dir):
    """First sightings merged batch by batch into keyed memory."""

    def merge(old, new):
        fresh_ = new.groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
        return fresh_ if old is None else old.unionByName(fresh_).groupBy("user_id", "event_type").agg(F.min("first").alias("first"))

    return flows.upsert(stream(spark, sf_dir, batches=4), merge).select("user_id", "event_type", F.unix_micros("first").alias("first_us"))


@query("""select event_type || '/' || user_id as query, count(*) as sightings, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, max(value) as top, arg_max(value, ts) as latest from events group by 1""")
def stream_trail(spark, sf_dir):
    """Keyed memory in full: first and last sighting, how many, the highest value and the newest, merged batch by batch."""

    def merge(old, new):
        rows = new.groupBy(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("query")).agg(F.count(F.lit(1)).alias("sightings"), F.min("ts").alias("first"), F.max("value").alias("top"), F.max(F.struct("ts", "value")).alias("newest"))
        both = rows if old is None else rows.unionByName(old)
        return both.groupBy("query").agg(F.sum("sightings").alias("sightings"), F.min("first").alias("first"), F.max("top").alias("top"), F.max("newest").alias("newest"))

    memory = flows.upsert(stream(spark, sf_dir, batches=4), merge)
    return memory.select("query", "sightings", F.unix_micros("first").alias("first_us"), F.unix_micros("newest.ts").alias("last_us"), "top", F.col("newest.value").alias("latest"))


@query("""with w as (select time_bucket(interval 7 day, ts, timestamp '1970-01-01') - k * interval 7 day as start, event_type from events, (select unnest([0, 1, 2, 3]) as k)), m as (select max(ts) - interval 1 day as mark from events) select epoch_us(start) as start_us, event_type, count(*) as n from w, m where start + interval 28 day <= mark group by 1, 2""")
def stream_sliding(spark, sf_dir):
    """Counts of four weeks, every week, that the watermark has closed."""
    out = flows.run(flows.sliding(stream(spark, sf_dir), "event_type", "28 days", "7 days"))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("""select event_type, user_id, 1 as n from events group by 1, 2""")
def stream_dedup(spark, sf_dir):
    """Each key once, however often it is seen within the watermark."""
    out = flows.run(flows.first_seen(stream(spark, sf_dir), ["event_type", "user_id"], "40 days"))
    return out.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g),
b as (select user_id, k, min(ts) as start, max(ts) + interval 2 hour as stop, count(*) as n from s group by 1, 2), m as (select max(ts) - interval 1 day as mark from events) select user_id, epoch_us(start) as start_us, n from b, m where stop <= mark""")
def stream_bursts(spark, sf_dir):
    out = flows.run(flows.bursts(stream(spark, sf_dir), "user_id"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""with f as (select user_id, min(ts) as first_ts from events group by 1) select f.user_id, epoch_us(first_ts) as first_us, epoch_us(min(ts)) as confirmed_us from f join events e on e.user_id = f.user_id and e.ts - first_ts >= interval 7 day group by 1, 2""")
def stream_confirmations(spark, sf_dir):
    """Two sightings a week apart, with keyed state."""
    return flows.run(flows.confirmations(stream(spark, sf_dir), "user_id"))


@query("""select cast(date_trunc('month', ts) as date)::varchar as month, event_type, arg_max(value, (event_id)) as value from events group by 1, 2""")
def stream_revisions(spark, sf_dir):
    """A revision supersedes the original: the highest version of each key, merged batch by batch."""

    def merge(old, new):
        rows = new.select(F.trunc(F.to_date("ts"), "MM").cast("string").alias("month"), "event_type", F.struct("event_id", "value").alias("v"))
        rows = rows if old is None else rows.unionByName(old)
        return rows.groupBy("month", "event_type").agg(F.max("v").alias("v"))

    return flows.upsert(stream(spark, sf_dir, batches=4), merge).select("month", "event_type", "v.value")


@query("""select n_name as name, r_name as region, cast(n_nationkey as bigint) as key from nation join region on n_regionkey = r_regionkey""")
def ods_scan(spark, sf_dir):
    """A spreadsheet of nations, written and read back: columns are found by name, behind a page of prose."""
    region = table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    lines = [["Nation Name", "", "", "Home region", "Location ID"], *([r["n_name"], "", "", r["r_name"], str(r["n_nationkey"])] for r in rows)]
    book = ods.write({"README": [["This page says what a location ID is, and much else that no header has " * 2]], "data": [[], [], *lines]})
    cells = ods.rows(spark.createDataFrame([("nations.ods", bytearray(book))], "path string, content binary")).where("sheet = 'data' and size(cells) > 0")
    names = ods.header(cells, "location id")
    found = ods.resolve(names, {"name": ["nation name"], "region": ["region"], "key": ["location id"]})
    return cells.where(F.lower(F.get("cells", F.lit(4))) != "location id").select(found["name"].alias("name"), found["region"].alias("region"), found["key"].cast("long").alias("key"))


@query("""select distinct url from pages where url is not null""")
def sitemap_scan(spark, sf_dir):
    """Sitemaps of a few pages each, found through an index of indexes; those of even number are compressed."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    number = F.floor(F.col("page_id") / 50)
    urls = F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit("</loc></url>"))), "")
    maps = pages.groupBy(number.alias("n")).agg(F.concat(F.lit("<urlset>"), urls, F.lit("</urlset>")).alias("xml")).select(F.format_string("map-%d", "n").alias("url"), "xml")
    link = lambda c: F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), c, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml")
    levels = pages.select(number.alias("n")).distinct().groupBy(F.floor(F.col("n") / 50).alias("group")).agg(link(F.format_string("map-%d", "n"))).select(F.format_string("index-%d", "group").alias("url"), "xml")
    top = levels.agg(link(F.col("url"))).select(F.lit("index").alias("url"), "xml")
    packed = landed.compressed(maps.union(levels).union(top), F.col("url").rlike("[02468]$"))
    return landed.sitemap_crawl(packed, "index")


@query("""select event_type as seed, 'q' || event_id as query, event_type = 'error' as is_breakout, case when event_type <> 'error' then cast(event_id as double) end as rise from events""")
def related_payloads(spark, sf_dir):
    """Rising queries out of nested payloads, with their labels read."""
    rows = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "error", "Breakout").otherwise(F.concat(F.lit("+"), F.format_number(F.col("event_id"), 0), F.lit("%")))
    each = rows.groupBy(F.col("event_type").alias("seed"), "user_id").agg(F.collect_list(F.struct(F.concat(F.lit("q"), "event_id").alias("query"), label.alias("value"), F.col("event_id").cast("double").alias("extracted_value"))).alias("rising"))
    payloads = each.select("seed", F.to_json(F.struct(F.struct("rising").alias("related_queries"))).alias("payload"))
    is_out, rise = X.rise_label(F.col("label"))
    return landed.rising_queries(payloads).select("seed", "query", is_out.alias("is_breakout"), rise.alias("rise"))


@query("""select o_orderpriority as code, sum(o_totalprice) as items from orders where o_orderpriority <> '5-LOW' group by 1 having false union all select * from (values ('A', 12.0), ('B', null)) as t(code, items)""")
def code_payloads(spark, sf_dir):
    """A null sum stays null."""
    payload = '{"success": true, "result": {"result": {"records": [{"code": "A", "items": "12"}, {"code": "B", "items": null}]}}}'
    return landed.code_records(spark.createDataFrame([(payload,), ("not json",)], "payload string"), "code", "items")
