"""Language, toxicity and quality: plain versions of the scores, held-out accuracy and awkward rows."""

import collections
import math

import numpy as np
import pytest
from settings import SF
from pyspark.sql import functions as F

from tidemark.llm import langid, quality, toxicity
from tidemark.llm.textkit import Words


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_code_lengths_against_a_plain_context_tree(spark):
    texts = {"xx": ["abab abac", "abba"], "yy": ["zzz yzy", "abz"]}
    docs = spark.createDataFrame([(k, t, lang) for lang, ts in texts.items() for k, t in enumerate(ts)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    probe = "abaz q"

    def plain(lang):
        counts = {}
        for t in texts[lang]:
            s = b"\n\n\n" + t.encode()
            for i in range(3, len(s)):
                for order in range(4):
                    counts.setdefault(s[i - order : i], {}).setdefault(s[i], 0)
                    counts[s[i - order : i]][s[i]] += 1
        bits, s = 0.0, b"\n\n\n" + probe.encode()
        for i in range(3, len(s)):
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    bits += 8
                    break
                here = counts.get(s[i - order : i])
                if here:
                    n, q = sum(here.values()), len(here)
                    if s[i] in here:
                        bits -= math.log2(here[s[i]] / (n + q))
                        break
                    bits -= math.log2(q / (n + q))
        return bits

    data = np.frombuffer(probe.encode(), np.uint8)
    got = model.bits(data, np.array([0, len(data)]), model.tables())[0]
    assert got == pytest.approx([plain(x) for x in model.langs], rel=1e-5)


def test_every_context_counts_beside_a_large_language():
    rng = np.random.default_rng(5)
    large = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    small = "мир и мед и мир да мед".encode()
    counts = []
    for text in (large, small):
        data = np.frombuffer(text, np.uint8)
        code, n = np.unique(langid.contexts(data, np.zeros(1, np.int64)).astype(np.int64) << 8 | data, return_counts=True)
        counts.append((code, n))
    assert len(np.unique(counts[0][0] >> 8)) > 12_000
    model = langid.Model(["large", "small"], counts)

    def plain(text, probe):
        seen, bits = {}, 0.0
        for order in range(4):
            s = b"\n\n\n" + text
            for i in range(3, len(s)):
                seen.setdefault(s[i - order : i], collections.Counter())[s[i]] += 1
        s = b"\n\n\n" + probe
        for i in range(3, len(s)):
            for order in (3, 2, 1, 0):
                if here := seen.get(s[i - order : i]):
                    n, q = sum(here.values()), len(here)
                    bits -= math.log2((here[s[i]] or q) / (n + q))
                    if here[s[i]]:
                        break
            else:
                bits += 8
        return bits

    for probe in (small, large[:3_000], b"mixed words \xd0\xbc\xd0\xb8!"):
        got = model.bits(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]), model.tables())[0]
        assert got == pytest.approx([plain(large, probe), plain(small, probe)], rel=1e-5)


def test_language_held_out(spark, tables):
    docs, _ = tables
    out = langid.query(spark, SF.rsplit("/", 1)[0] + "/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_awkward_rows(spark, awkward, empty):
    rows = langid.identify(awkward, langid.train(awkward)).collect()
    assert len(rows) == 9 and [r["lang_pred"] for r in rows if not r["text"] or not r["text"].strip()] == ["und"] * 3
    assert next(r for r in rows if r["doc_id"] == 6)["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.train(empty) is None
    assert {r["lang_pred"] for r in langid.identify(awkward, None).collect()} == {"und"}
    assert langid.identify(empty, langid.train(awkward)).count() == 0


def test_machine_against_the_plain_sum():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(4, np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.integers(0, 2, (5, 6)).astype(float)
    pairs = [m.bias + r @ m.weight + sum(m.factor[i] @ m.factor[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert m.margin(x) == pytest.approx(pairs)


def test_machine_learns_a_pair_that_single_words_miss():
    """Each word stands in as many texts of either label; only both together, or neither, tell. Frequent other words say nothing."""
    rng = np.random.default_rng(2)
    lists, label = [], []
    for k in range(1_200):
        a, b = k & 1, k >> 1 & 1
        lists.append(np.unique(np.array([w for w, on in ((3, a), (5, b)) if on] + [9, *rng.integers(20, 60, 6)], np.int32)))
        label.append(int(a == b))
    label = np.array(label, float)
    assert {3, 5} <= set(toxicity.paired(lists, label, np.arange(64), 6).tolist())
    m = toxicity.fit(lists, label, bits=6, terms=4, rounds=400, min_docs=1)
    place = {c: k for k, c in enumerate(m.chosen.tolist())}
    assert {3, 5} <= set(place)
    x = np.zeros((4, len(place)))
    for row, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        x[row, place[3]], x[row, place[5]] = a, b
    assert (m.score(x) >= 0.5).tolist() == [True, False, False, True]


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    scored = toxicity.query(spark, SF.rsplit("/", 1)[0] + "/sf0.1").join(spark.read.parquet(SF.rsplit("/", 1)[0] + "/sf0.1/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.8
    assert counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0)) < 0.02


def test_toxicity_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    machine = toxicity.train(awkward, labels, min_docs=1)
    rows = toxicity.score(awkward, machine).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    none = toxicity.train(empty, labels.limit(0))
    assert {r["score"] for r in toxicity.score(awkward, none).collect()} == {0.5} and toxicity.score(empty, machine).count() == 0


def test_thresholds_stay_in_order_and_grades_are_told_apart():
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 4, 800)
    x = np.zeros((800, quality.WIDTH), np.float32)
    x[np.arange(800), grade] = 1
    x[:, 10] = rng.random(800)
    s = quality.fit(x, grade.astype(float))
    assert (np.diff(s.cuts) > 0).all()
    tails = s.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(s.expected(tails), grade)[0, 1] > 0.95


def test_scale_against_a_plain_likelihood():
    """Tails and grades as written out by hand, and weights and thresholds at which the likelihood's numerical slope is zero."""
    rng = np.random.default_rng(9)
    x = np.zeros((150, quality.WIDTH), np.float32)
    x[:, :3] = rng.random((150, 3))
    grade = np.digitize(2 * x[:, 0] - x[:, 1] + rng.logistic(0, 0.5, 150), [0.2, 1.0]).astype(float) * 2  # grades 0, 2, 4
    decay = 2e-3
    s = quality.fit(x, grade, rounds=4_000, rate=0.02, decay=decay)

    def plain(weight, cuts):
        total = 0.0
        for row, g in zip(x[:, :3].astype(float), grade):
            eta = float(row @ weight)
            below = [1 / (1 + math.exp(-(c - eta))) for c in cuts]
            bounds = [0.0, *below, 1.0]
            total -= math.log(bounds[int(g) // 2 + 1] - bounds[int(g) // 2])
        return total / len(grade) + decay / 2 * float(weight @ weight)

    point = np.concatenate([s.weight[:3].astype(float), s.cuts])
    slope = [(plain(*np.split(point + d, [3])) - plain(*np.split(point - d, [3]))) / 2e-5 for d in np.eye(5) * 1e-5]
    assert np.abs(slope).max() < 2e-3 and plain(*np.split(point, [3])) < plain(np.zeros(3), s.cuts) - 0.05
    for row in x[:5]:
        eta = sum(float(a) * float(b) for a, b in zip(row, s.weight))
        above = [1 / (1 + math.exp(float(c) - eta)) for c in s.cuts]
        tails = s.tails(row[None, :])
        assert tails[0] == pytest.approx(above, rel=1e-4)
        assert s.expected(tails)[0] == pytest.approx(0 * (1 - above[0]) + 2 * (above[0] - above[1]) + 4 * above[1], rel=1e-4)


def test_quality_features_against_plain_counts():
    text = "The the cat, 12 CATS"
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in text)
    got = quality.features(Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])))[0]
    grams = collections.Counter(shape[k : k + 4] for k in range(len(shape) - 3))
    assert sorted(np.round(got[: 1 << quality.SHAPE_BITS][got[: 1 << quality.SHAPE_BITS] > 0] ** 2 * sum(grams.values()))) == sorted(grams.values())
    words = collections.Counter(text.lower().replace(",", "").split())
    body = got[1 << quality.SHAPE_BITS : -1]
    assert sorted(np.round(body[body > 0] ** 2 * 5)) == sorted(words.values()) and got[-1] == pytest.approx(math.sqrt(1 / 5))


def test_quality_held_out(spark, tables):
    _, labels = tables
    rated = quality.query(spark, SF.rsplit("/", 1)[0] + "/sf0.01").join(labels, "doc_id").where("held_out")
    assert rated.agg(F.avg((F.col("selected") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.9


def test_quality_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    scale = quality.train(awkward, quality.graded(labels))
    rows = quality.rate(awkward, scale).collect()
    assert len(rows) == 9 and all(0 <= r["expected_grade"] <= 2 for r in rows)
    kept = quality.select(awkward, scale)
    assert kept.columns == awkward.columns
    none = quality.train(empty, quality.graded(labels.limit(0)))
    assert {r["expected_grade"] for r in quality.rate(awkward, none).collect()} == {0.0} and quality.select(awkward, none).count() == 9
