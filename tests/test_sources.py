"""Spreadsheets, PDFs and landed payloads."""

import pytest
from pyspark.sql import functions as F
from settings import SF

from tidemark.sources import landed, ods, pdf


def test_spreadsheet_repeats_and_errors(spark):
    book = ods.write({"README": [["location id " * 10]], "data": [["Location ID", "", "", "Name"], ["1", "", "", "A & B"], *[[""] * 300] * 60_000, ["2", "", "", "C"]]})
    files = spark.createDataFrame([("good", bytearray(book)), ("bad", bytearray(b"not a zip"))], "path string, content binary")
    rows = ods.rows(files).cache()
    assert rows.where("error is not null").count() == 1
    data = rows.where("sheet = 'data' and size(cells) > 0")
    names = ods.header(data, "location id")
    found = ods.resolve(names, {"id": ["location id"], "name": ["name"], "area": ["area"]}, optional=("area",))
    got = data.select(*(c.alias(n) for n, c in found.items())).where("id <> 'Location ID'").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "A & B", None), ("2", "C", None)]
    with pytest.raises(ValueError):
        ods.resolve(names, {"area": ["area"]})


def test_spreadsheet_repeats_in_full():
    book = ods.write({"a": [["x"] * 300, *[["r", "", "s"]] * 70, [""], ["", "last"]]})
    capped, whole = list(ods.parse(book)), list(ods.parse(book, None, None))
    assert len(capped[0][1]) == 260 and len(capped) == 1 + 50 + 2
    assert len(whole[0][1]) == 300 and len(whole) == 1 + 70 + 2 and whole[-1] == ("a", ["", "last"]) and whole[-2] == ("a", [])


def test_memory_goes_on_where_a_run_ended(spark, tmp_path):
    from tidemark.streaming import flows

    def merge(old, new):
        sums = new.groupBy("k").agg(F.sum("n").alias("n"))
        return sums if old is None else sums.unionByName(old).groupBy("k").agg(F.sum("n").alias("n"))

    folders = f"file://{tmp_path}/memory", f"file://{tmp_path}/progress"
    for n in range(4):
        spark.createDataFrame([("a", 1), ("b", n)], "k string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = flows.upsert(flows.source(spark, f"{tmp_path}/in", "k string, n long", max_files=1), merge, *folders)
        assert {r["k"]: r["n"] for r in got.collect()} == {"a": n + 1, "b": n * (n + 1) // 2}
    assert flows._committed(spark, folders[0]) == [2, 3]


@pytest.fixture
def small_pieces(spark):
    """Groups reach Python in pieces of three rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_confirmations_in_pieces_give_the_rows_of_the_sql(spark, duck, same, small_pieces):
    from tidemark.plans import registry

    registry.load()
    same(registry.QUERIES["stream_confirmations"](spark, SF), duck, registry.ORACLE_SQL["stream_confirmations"])


def test_confirmations_with_sightings_out_of_order(spark, tmp_path, small_pieces):
    from tidemark.streaming import flows

    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    batches = [
        [("a", day(n)) for n in (30, 9, 20, 12, 8, 25, 2, 15, 10, 1)] + [("b", day(9)), ("b", day(11)), ("c", day(3)), ("c", day(3)), ("d", None), ("d", day(1)), (None, day(1)), (None, day(20))],
        [("a", day(7)), ("b", day(3)), ("c", day(9)), ("d", day(8))],
        [("b", day(1)), ("c", day(10)), ("e", day(1))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = flows.run(flows.confirmations(flows.source(spark, f"{tmp_path}/in", "k string, ts timestamp", max_files=1), "k"))
    days = {r["k"]: (r["first_us"] // 86_400_000_000 - 19_722, r["confirmed_us"] // 86_400_000_000 - 19_722) for r in got.collect()}
    assert got.count() == 4 and days == {"a": (1, 8), "b": (3, 11), "c": (3, 10), "d": (1, 8)}


def test_report_state_advances_after_success_only(spark, tmp_path):
    from tidemark.sources import sinks

    path = f"{tmp_path}/state"
    rows = lambda n: spark.createDataFrame([(n,)], "n long")
    sinks.advance(rows(1), path, lambda: None)
    with pytest.raises(RuntimeError):
        sinks.advance(rows(2), path, lambda: (_ for _ in ()).throw(RuntimeError("not sent")))
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [1]


def test_pdf_text(spark):
    data = pdf.build(["PL 1 (new) approval", "second line"])
    files = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    assert pdf.texts(files).first()["text"] == "PL 1 (new) approval\nsecond line"
    assert pdf.text(b"") == "" and pdf.text(b"stream\n[(ab) -250 (c)] TJ BT\nendstream") == "ab c"


def test_references_without_a_semicolon(spark, duck, same, tmp_path):
    from tidemark.plans import registry
    from tidemark.sources import pages

    registry.load()
    html = [
        "<html><head><title>a &amp</title></head><body><h1>a &amp;&amp</h1><p>b &amp;amp; &amp;copy; c</p></body></html>",
        "<p>cut&amp</p><p>&copy 2024 &copy; 2024 &middot &middot; &quot &quot;</p><p>&ampere &am &quo & && &; &#38 &nosuch; &ampere;</p>",
        '<body><a href="/x?a=1&amp;b=2&copy=3">x &amp y</a><script>if (a && b) c = "&amp"</script><!-- &amp --> z',
        "the page ends within &am",
        "<p>a<!-- c -->b<script>c</script><noscript><p>c</p></noscript>d<b>e</b><br/>f</p><p>the page ends within</p",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duck.cursor()
    con.execute(f"create temp view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(registry.QUERIES["page_text"](spark, f"{tmp_path}"), con, registry.ORACLE_SQL["page_text"])
    assert pages.read("a<3 <i>b</i>c<!-- d -->e</p") == ("a<3 b ce</p", [])
    assert pages.read("a &amp b &copy; &nosuch; &#65") == ("a & b © &nosuch; A", [])
    assert pages.read("a &amp b &copy; &nosuch; &#65 &#65;", bare=False) == ("a &amp b © &nosuch; &#65 A", [])
    assert pages.read('<a href="/x?a=1&amp;b=2&copy=3">', bare=False) == ("", ["/x?a=1&b=2&copy=3"])


def test_null_sums_stay_null(spark):
    payload = '{"success": true, "result": {"result": {"records": [{"code": "A", "items": "12"}, {"code": "B", "items": null}]}}}'
    rows = landed.code_records(spark.createDataFrame([(payload,)], "payload string"), "code", "items")
    assert {r["code"]: r["items"] for r in rows.collect()} == {"A": 12.0, "B": None}


def test_waiting_times(spark, tmp_path):
    head = "RTT Part Type,Commissioner Org Code,Treatment Function Name,Gt 00 To 01 Weeks SUM 1,Gt 18 To 19 Weeks SUM 1,Gt 52 To 53 Weeks SUM 1,Total All"
    lines = ['Part_2,A1,Dental,5,"1,234",2,"1,241"', "Part_2,NONC,Dental,9,9,9,27", "Part_1A,A1,Dental,9,9,9,27", "Part_2,A2,Dental,,1,bad,1"]
    (tmp_path / "x.csv").write_text("\n".join([head, *lines]))
    assert [tuple(r) for r in landed.waiting_times(spark, str(tmp_path / "x.csv")).collect()] == [("Dental", 1242, 1237, 2)]


def test_revised_files_win(spark):
    index = spark.createDataFrame([("2024-01", "a/x.csv"), ("2024-01", "a/x-revised.csv"), ("2024-02", "a/y.csv")], "month string, url string")
    assert {r["month"]: r["url"] for r in landed.newest_per_month(index).collect()} == {"2024-01": "a/x-revised.csv", "2024-02": "a/y.csv"}


def test_counts_of_csv_cells(spark):
    rows = spark.createDataFrame([("1,234",), ("",), ("x",), (None,)], "c string").select(landed.count(F.col("c")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [1234, 0, 0, 0]
