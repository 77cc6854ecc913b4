import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n):
    out = {}
    for d, text in docs:
        ws, hit, ids = words(text), set(), set()
        for i, body in items:
            bs = words(body)
            size = min(n, len(bs))
            for a in range(len(bs) - size + 1) if size else ():
                for b in range(len(ws) - size + 1):
                    if ws[b : b + size] == bs[a : a + size]:
                        hit.update(range(b, b + size))
                        ids.add(str(i))
        out[d] = (len(ws), len(hit), sorted(ids))
    return out


DOCS = [(1, "A b C d e; f g h! i j k l"), (2, "x a B c d e f g h i j y a b c d e f g h i j"), (3, "short item"), (4, "Short, ITEM short item é"), (5, None), (6, ""), (7, "nothing")]
ITEMS = [(10, "a b c d e f g h i j"), (11, "short item"), (12, None), (13, "..."), (10, "a b c d e f g h i j")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_against_brute_force_in_one_and_in_many_blocks(spark, block):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_contamination(docs, bench, keep=["doc_id"], block_bytes=block).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == brute(DOCS, ITEMS, 10)


def test_spans_are_cut_and_documents_dropped(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, bench).collect()}
    assert cut[2] == "x  y " and cut[4] == " é" and cut[5] is None and cut[7] == "nothing"
    assert sorted(r["doc_id"] for r in decontam.drop_documents(docs, bench).collect()) == [5, 6, 7]


def test_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(None, "quick brown fox"), (2, "word1 word2")], "item_id long, text string")
    rows = decontam.find_contamination(awkward, bench).collect()
    assert len(rows) == 9 and sum(r["n_hit"] == 3 and r["items"] == [] for r in rows) == 2
    kept = decontam.drop_documents(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == 6
    assert decontam.find_contamination(empty, bench).count() == 0
    assert decontam.find_contamination(awkward, bench.limit(0)).where(F.col("n_hit") > 0).count() == 0


def test_patterns_stay_small():
    items = [(k, " ".join(f"w{(k * 7919 + j * 31) % 5003}" for j in range(300))) for k in range(400)]
    patterns = decontam.Patterns(items, 10)
    size = sum(len(t) + 16 for _, t in items)
    assert patterns.nbytes() < 12 * size


def test_other_words_of_the_same_hash(monkeypatch):
    """With all hashes equal the words alone decide."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.textkit import Words, words_of

    monkeypatch.setattr(Words, "grams", lambda self, n: np.full(max(0, len(self) - n + 1), 7, np.uint64))
    items = [("a", "one two three"), ("b", "two three four"), ("c", "one two three"), (None, "three four five")]
    find = decontam.Patterns(items, 3).scanner()
    words = next(words_of(pa.array(["zero One two three four five", "one two", ""])))[2]
    assert sorted((k, size, sorted(map(str, ids))) for k, size, ids in find(words)) == [(1, 3, ["a", "c"]), (2, 3, ["b"]), (3, 3, ["None"])]
