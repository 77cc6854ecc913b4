import gzip

import pytest

from tidemark.llm import warc

PAGES = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, "http://a/2", "other é"), (4, None, None), (5, "http://a/5", ""), (1, "http://a/1", "same"), (6, "http://a/6\nx", "z" * 300_000), (None, "http://a/n", "same")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, file_bytes=2_000)
    return path


def test_round_trip_and_revisits(spark, archive):
    rows = {}
    for r in spark.read.format("warc").load(archive).collect():
        rows.setdefault(r["record_id"], []).append(r)
    one = lambda k: rows[f"<urn:record:{k}>"][0]
    assert sum(map(len, rows.values())) == len(PAGES)
    assert one(1)["record_type"] == "response" and len(rows["<urn:record:1>"]) == 2
    assert one(3)["record_type"] == "revisit" and one(3)["refers_to"] == "<urn:record:1>" and one(3)["payload_length"] == 4 and one(3)["payload"] is None
    assert one("null")["record_type"] == "revisit" and one(5)["refers_to"] == "<urn:record:4>"
    assert bytes(one(2)["payload"]).decode() == "other é" and one(2)["payload_digest"] == warc.digest("other é".encode())
    assert all(r["digest_ok"] for rs in rows.values() for r in rs if r["record_type"] == "response")
    assert one(6)["payload_length"] == 300_000 and one(6)["target_uri"] == "http://a/6 x"


def test_predicates_are_pushed_and_payloads_skipped(spark, archive, capsys):
    df = spark.read.format("warc").load(archive)
    hit = df.where("record_type = 'revisit' and target_uri like 'http://a/3%'")
    assert [r["record_id"] for r in hit.collect()] == ["<urn:record:3>"]
    reader = warc.WarcReader({"path": archive, "payload": "none"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and reader.tests == [("warc-type", "in", ("response",))]
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert {x["record_type"] for x in rows} == {"response"} and all(x["payload"] is None for x in rows)
    assert sorted(x["payload_length"] for x in rows)[-1] == 300_000
    assert df.where("record_type in ('response')").count() == 5


def test_files_of_other_writers(spark, tmp_path):
    """Plain files, and gzip members without lengths."""
    records = [warc.record({"record_type": "response", "record_id": f"<urn:record:{k}>", "warc_date": "d", "target_uri": "u", "payload": b"p" * k, "payload_length": k, "payload_digest": warc.digest(b"p" * k)}) for k in (0, 7, 90_000)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    warc.register(spark)
    for payload in ("bytes", "none"):
        rows = spark.read.format("warc").option("payload", payload).load(str(tmp_path)).collect()
        assert sorted(r["payload_length"] for r in rows) == [0, 0, 7, 7, 90_000, 90_000]
        assert all(r["digest_ok"] is (True if payload == "bytes" else None) for r in rows)


def test_digests_are_pushed_whatever_their_algorithm_s_name(spark, archive):
    from pyspark.sql.datasource import EqualTo

    wanted = warc.digest(b"same")
    reader = warc.WarcReader({"path": archive, "payload": "none"})
    assert list(reader.pushFilters([EqualTo(("payload_digest",), wanted)])) == []
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert {x["payload_digest"] for x in rows} == {wanted} and len(rows) == 4
    assert spark.read.format("warc").load(archive).where(f"payload_digest = '{wanted}'").count() == 4


def test_further_columns_with_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a", "x", 9, b"z"), (2, "u", "a", None, None, None)], "page_id long, url string, html string, sha string, payload_length int, payload binary")
    warc.archive(pages, str(tmp_path / "c"))
    rows = {r["record_id"]: r for r in spark.read.format("warc").load(str(tmp_path / "c")).collect()}
    assert bytes(rows["<urn:record:1>"]["payload"]) == b"a" and rows["<urn:record:2>"]["refers_to"] == "<urn:record:1>"


def test_empty_table(spark, tmp_path):
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(k, "u", "ab") for k in range(3)] + [(k, "u", "abcdef") for k in range(3, 6)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "m"), min_bytes=5)
    kinds = spark.read.format("warc").load(str(tmp_path / "m")).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in kinds} == {"response": 4, "revisit": 2}
