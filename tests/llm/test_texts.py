"""Fingerprints, licenses, tokens, near-duplicates, main text and the pipeline against plain versions."""

import base64
import collections
import fractions
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from settings import SF

from tidemark.llm import bpe, fingerprint, html, licenses, neardup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def jaccard(a, b):
    a, b = (collections.Counter(t.lower().split()) for t in (a, b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints_estimate_the_weighted_index(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edited(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    misses = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        misses.append((got[i]["near_edited"] - jaccard(text, edited), got[i]["near_next"] - jaccard(text, after)))
    misses = np.array(misses)
    assert np.abs(misses.mean(0)).max() < 0.03 and misses.std(0).max() < 0.08


def test_samples_against_plain_draws(spark):
    """Every function's gamma and uniform draws, samples and fingerprint bytes, written out for a few texts."""
    import xxhash

    of_long = lambda x: xxhash.xxh64((x & (1 << 64) - 1).to_bytes(8, "little"), seed=42).intdigest()

    def drawn(text, k):
        best = None
        for term, count in collections.Counter(text.lower().split()).items():
            term = xxhash.xxh64(term.encode(), seed=42).intdigest()
            one, two = (of_long(term ^ fingerprint._constant(2 * k + j) & (1 << 64) - 1) for j in (0, 1))
            unit = lambda h, shift, bits: ((h >> shift & (1 << bits) - 1) + 0.5) * 0.5**bits
            r = -math.log(unit(one, 0, 21) * unit(one, 21, 21))
            b = unit(one, 42, 21)
            t = math.floor(math.log(count) / r + b)
            log_a = math.log(-math.log(unit(two, 0, 32) * unit(two, 32, 32))) - r * (t - b + 1)
            place = math.floor((max(min(log_a, 100.0), -100.0) + 128.0) * fingerprint.SCALE)
            mark = xxhash.xxh64((t & (1 << 64) - 1).to_bytes(8, "little"), seed=of_long(term)).intdigest()  # a hash of two columns is seeded by that of the first
            number = place << 31 | mark & (1 << 31) - 1
            best = number if best is None or number < best else best
        return best

    texts = ["a b c a d", "The cat and the other cat", "x", "w1 w2 w3 " * 9 + "w4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.compare_with_edited(docs).collect()}
    for i, text in enumerate(texts):
        digits = [f"{of_long(drawn(text, k)) & 0xFFFFFFFF:08x}" for k in range(fingerprint.SAMPLES)]
        assert got[i] == "".join(digits)


def test_samples_drawn_together_are_those_drawn_apart(spark):
    """Terms of one text only, of both equally often, of both unequally, and texts without terms."""
    texts = [(1, "a b b c c d", "a b c c e"), (2, "x y", ""), (3, "", "x y"), (4, "", " "), (5, "p q q", "q p q"), (6, "Longer words Repeat repeat", "longer words repeat")]
    rows = [(k, which, text) for k, *both in texts for which, text in enumerate(both)]
    docs = spark.createDataFrame(rows, "k int, which int, text string")
    names = [f"s{k}" for k in range(fingerprint.SAMPLES)]
    apart = {(r["k"], r["which"]): [r[c] for c in names] for r in fingerprint.fingerprints(docs, ["k", "which"]).collect()}
    together = {r["k"]: (r["own"], r["other"]) for r in fingerprint.paired_fingerprints(docs, ["k"]).collect()}
    for k, *_ in texts:
        assert together.get(k, (None, None)) == (apart.get((k, 0)), apart.get((k, 1)))
    assert together[5][0] == together[5][1] and 4 not in together


def test_fingerprints_of_awkward_rows(spark, awkward, empty):
    rows = fingerprint.compare_with_edited(awkward).collect()
    assert len(rows) == 9
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 4)} == {""}
    assert fingerprint.compare_with_edited(empty).count() == 0
    alone = fingerprint.compare_with_edited(awkward.where("doc_id = 7")).first()
    assert alone["near_next"] == 1.0


@pytest.mark.parametrize("ranges", [1, 3, 50, 5_000])
def test_the_next_document_is_found_across_ranges(spark, ranges):
    ids = [5, -3, 0, 12, 900, 901, 10**12, 7]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["id"]: r["next"] for r in fingerprint.with_neighbour(docs, ranges=ranges).where("not ghost").collect()}
    order = sorted(ids, reverse=True)
    want = {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    if ranges == 1:  # the last is then followed by the ghost of the first, or by nothing where it has none
        want[min(ids)] = got[min(ids)]
        assert got[min(ids)] in (None, f"t{max(ids)}")
    assert got == want


def test_the_plan_does_not_grow_with_the_number_of_ranges(spark):
    """Each range once was an expression, and with many of them the driver needed too much memory."""
    docs = spark.range(5_000).selectExpr("id as doc_id", "concat('t', id) as text")
    few, many = (fingerprint.with_neighbour(docs, ranges=n)._jdf.queryExecution().analyzed().toString() for n in (8, 1_600))
    assert few.count("CASE WHEN") == many.count("CASE WHEN") and few.count("map(") == many.count("map(")
    assert many.count("cast(") < few.count("cast(") + 20


def test_rows_without_ids_follow_one_another(spark):
    """After the last comes the first, also where no row has an id."""
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (None, "c")], "doc_id long, text string")
    got = {r["text"]: r["next"] for r in fingerprint.with_neighbour(docs).where("not ghost").collect()}
    assert got == {"a": "b", "b": "c", "c": "a"}
    assert fingerprint.compare_with_edited(docs.where("text = 'a'")).first()["near_next"] == 1.0


@pytest.mark.parametrize("first", [10**18, -(2**63), 2**63 - 2_500])
def test_very_large_ids_in_many_ranges(spark, first):
    """Neighbouring ids that are the same as doubles, and the largest and smallest ones."""
    docs = spark.range(2_500).selectExpr(f"{first}L + id as doc_id" if first > -(2**63) else "id - 9223372036854775807L - 1L as doc_id", "concat('t', id) as text")
    got = {r["text"]: r["next"] for r in fingerprint.with_neighbour(docs, ranges=5_000).where("not ghost").collect()}
    assert got == {f"t{k}": f"t{(k - 1) % 2_500}" for k in range(2_500)}


def test_licenses_in_awkward_rows(spark, awkward, empty):
    rows = licenses.find_licenses(awkward).collect()
    assert len(rows) == 9 and all(r["n_base"] == 0 and r["base_labels"] == "" for r in rows)
    assert licenses.find_licenses(empty).count() == 0


def test_licenses_near_and_exact(spark):
    texts = [
        "Released under\nthe MIT license. Under the MIT, licensed. UNDER THE MIT LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files",
        "cc by nc" * 1, "cc-by-ncx by nc", "x " * 5_000 + "Apache License, Version 2.0", "Licensed under GNU General Public License version 3 this work is", "license the mit under", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.find_licenses(docs).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 1, 9, "mit")
    assert got[1]["n_base"] == 0 and got[1]["labels"] == "mit" and 0.85 <= got[1]["score"] < 1
    assert got[2]["base_labels"] == "cc-by-nc" and got[3]["n_base"] == 0 and got[4]["first_word"] == 5_000
    assert got[5]["labels"] == "gpl-3" and got[6]["base_labels"] == "" and got[7]["n_words"] == 0


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_licenses_of_an_exact_and_an_edited_notice_in_one_block(spark):
    isc, bsd, gpl = (next(t for t, label in licenses.TEMPLATES if label == want) for want in ("isc", "bsd", "gpl-3"))
    edited = {t: t.replace(a, b) for t, a, b in ((isc, "fee", "charge"), (bsd, "forms", "shapes"))}
    rows = [(1, f"licensed under the mit license {edited[isc]}", "isc,mit"), (2, f"{edited[bsd]} and licensed under the mit license", "bsd,mit"), (3, gpl, "gpl-3"), (4, f"{gpl} or {edited[isc]}", "gpl-3,isc")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.find_licenses(docs).collect()}
    assert got == {i: labels for i, _, labels in rows}


def test_licenses_by_long_templates_and_ascii_case_only(spark):
    rng = random.Random(4)
    long = [f"clause{k}" for k in range(130)]
    edited = [w if rng.random() < 0.92 else "x" for w in long]
    rows = [(1, "a b " * 300 + " ".join(edited) + " tail", "whole"), (2, " ".join(long[:60]), ""), (3, "we wor\u212a here", ""), (4, "WE WORK HERE", "work")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.find_licenses(docs, phrases=[], templates=[(" ".join(long), "whole"), ("we work here", "work")]).collect()}
    assert got == {i: labels for i, _, labels in rows}
    none = licenses.find_licenses(docs, phrases=[], templates=[])
    assert sorted((r["doc_id"], r["n_words"], r["labels"]) for r in none.collect()) == [(1, 731, ""), (2, 60, ""), (3, 3, ""), (4, 3, "")]


def test_tokens_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "")


def test_tokens_of_random_and_long_pieces(library):
    codec = bpe.Codec(bpe.Merges(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ["", " ", "\n\n  x", "a" * 3_000, "ing" * 2_000, "<|endoftext|>"] + ["".join(rng.choice("abé the 日ing\n\t12.,!ßñA😀'") for _ in range(rng.randint(0, 500))) for _ in range(150)]
    texts += ["".join(rng.choice("abthingeros") for _ in range(rng.randint(200, 900))) for _ in range(40)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == library.encode_ordinary(text) and codec.decode(ids).decode() == text


def test_tokens_of_awkward_rows(spark, awkward, empty):
    back = bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]), RANKS)
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in back.collect())
    assert texts == sorted((r["doc_id"] or -1, r["text"] or "") for r in awkward.collect())
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    clash = awkward.selectExpr("doc_id", "text", "'old' as ids", "-1 as n_tokens", "lang")
    rows = bpe.round_trip(clash, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def brute_components(rows, n, percent):
    sets = {i: neardup.shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, u in enumerate(ids):
        for v in ids[:k]:
            common = len(sets[u] & sets[v])
            if common and 100 * common >= percent * len(sets[u] | sets[v]):
                a, b = sorted((find(u), find(v)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, n, percent):
    rng = random.Random(n)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for ws in base:
        for _ in range(rng.randint(1, 14)):
            copy = list(ws)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(9_000, ""), (9_001, None), (9_002, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, n=n, percent=percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_near_duplicates_of_awkward_rows(spark, awkward, empty):
    rows = neardup.near_duplicates(awkward).collect()
    assert len(rows) == 9 and all(r["kept"] for r in rows) and sum(r["component_id"] is None for r in rows) == 1
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    near = x.replace("x39", "x40")
    rows = [(1, x, "a"), (5, x, "b"), (5, y, "c"), (7, z, "d"), (7, z, "e"), (8, near, "f"), (None, x, "g"), (9, "", "h"), (9, "", "i"), (10, None, "j")]
    docs = spark.createDataFrame(rows, "id long, text string, key string")
    found = sorted((r["id"] or -1, r["component_id"] or -1) for r in neardup.near_duplicates(docs, key="id").collect())
    assert found == [(-1, -1), (1, 1), (5, 1), (5, 5), (7, 7), (7, 7), (8, 1), (9, 9), (9, 9), (10, 10)]
    kept = neardup.drop_near_duplicates(docs, key="id")
    got = sorted((r["id"] or -1, r["text"] or "") for r in kept.collect())
    assert kept.columns == docs.columns and got == sorted([(1, x), (5, y), (7, z), (-1, x), (9, ""), (9, ""), (10, "")])


def test_near_duplicates_leave_only_their_result(spark):
    import os

    from tidemark.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(k, f"a b c d e f g h i j k {k % 2}") for k in range(20)], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 20
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"near-result"}


def test_near_links_of_groups_around_a_common_passage(spark):
    """Buckets that hold several components, more members than a block has, and pairs that only the blocks find."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for _ in range(90):
        own = [f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(6, 14))]
        for _ in range(rng.randint(1, 3)):
            rows.append(" ".join(passage + own[: len(own) - rng.randint(0, 3)]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)
    for block in (512, 7):
        neardup.BLOCK, old = block, neardup.BLOCK
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, n=3, percent=85).collect()}
        finally:
            neardup.BLOCK = old
        assert got == want


def test_bands_miss_a_link_once_in_a_million():
    for percent in (80, 85, 95):
        assert (1 - (percent / 100) ** neardup.ROWS) ** neardup.bands_for(percent) <= neardup.MISS


def test_bands_and_signatures_together_miss_a_link_once_in_a_million(monkeypatch, spark):
    asked = {}
    monkeypatch.setattr(neardup, "_alike", lambda least, real=neardup._alike: asked.update(least=least) or real(least))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "doc_id long, text string")
    for percent in (80, 85, 95):
        neardup.near_duplicates(docs, percent=percent)
        share, count = fractions.Fraction(percent, 100), neardup.bands_for(percent) * neardup.ROWS
        gate = sum(math.comb(count, k) * share**k * (1 - share) ** (count - k) for k in range(count + 1) if k / count < asked["least"])
        assert gate + (1 - share**neardup.ROWS) ** neardup.bands_for(percent) <= neardup.MISS


def blocks_found(pages, model):
    """Precision and recall of blocks of text."""
    both = got = want = 0
    for page, lines in pages:
        found, true = (collections.Counter(x for x in lines_ if x) for lines_ in (html.main_text(page, model).split("\n"), lines))
        both, got, want = both + sum((found & true).values()), got + sum(found.values()), want + sum(true.values())
    return both / got, both / want


@pytest.fixture(scope="module")
def main_model():
    return html.default_model()


def test_main_text_of_unseen_pages(main_model):
    pages = html.labelled_pages(120, seed=77)
    right = sum(html.main_text(page, main_model).split("\n") == [x for x in text.split("\n") if x] for page, text in pages)
    assert right >= 100


@pytest.mark.parametrize("layout,least", [("plain", 0.7), ("post", 0.95)])
def test_main_text_of_a_layout_that_training_lacks(layout, least):
    model = html.train(html.labelled_pages(layouts=[x for x in html.LAYOUTS if x != layout]))
    precision, recall = blocks_found([(p, t.split("\n")) for p, t in html.labelled_pages(40, seed=77, layouts=[layout])], model)
    assert precision >= 0.95 and recall >= least


def test_main_text_of_foreign_pages_labelled_by_hand(main_model):
    from foreign_pages import PAGES

    precision, recall = blocks_found(PAGES, main_model)
    assert precision >= 0.9 and recall >= 0.9


def test_main_text_of_the_table_pages(spark, main_model):
    """There the story is what stands in article."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        lines = []
        for n in html.parse(r["html"] or ""):
            up = n
            while up is not None and up.tag != "article":
                up = up.parent
            if n.tag is None and up is not None:
                lines.append(n.text)
        assert html.main_text(r["html"] or "", main_model) == "\n".join(lines)


def test_quotes_open_values_after_an_equals_sign_only(main_model):
    text = lambda page: html.main_text(page, main_model)
    assert text("<p title=it's>A first paragraph of several words.</p><p>isn't this B, the second one?</p>") == "A first paragraph of several words.\nisn't this B, the second one?"
    assert text('<article><p class=foo">A long block of text here.</p><div class="x"><p>Second block of it.</p></div></article><footer>F</footer>') == "A long block of text here.\nSecond block of it."
    assert [n.text for n in html.parse('<a href="x>y" title=\'<p>\'>one</a><p a=\'"\'b="\'">two</p><p =x="1>3" y>three') if n.tag is None] == ["one", "two", "three"]
    assert html.parse('<p>shown</p><p class="never closed>lost</p>')[-1].text == "shown"


def test_main_text_without_other_parts(main_model):
    lines = ["Title of this page", "One long sentence that stands here all by itself and has many words.", "Another paragraph of the story."]
    for page in (f"<article><p>{lines[1]}</p></article>", f"<p>{lines[1]}</p>", lines[1]):
        assert html.main_text(page, main_model) == lines[1]
    assert html.main_text(f"<body><h1>{lines[0]}</h1><p>{lines[1]}</p><p>{lines[2]}</p></body>", main_model) == "\n".join(lines)


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    def seconds(page):
        begun = time.process_time()
        html.parse(page)
        return time.process_time() - begun

    for make in (lambda n: "<div>" * n + "x", lambda n: "<p><object>" + "<div>" * n + "x", lambda n: "<a href=x><b>" * n + "</a>" * n + "x", lambda n: '<p a="b>' * n + '">x', lambda n: "<p>" * n + "x", lambda n: "a <b " * n + ">x"):
        seconds(make(2_000))
        assert seconds(make(40_000)) < 40 * max(seconds(make(4_000)), 0.02)


def test_messages_give_the_marginals_of_all_labellings():
    model = html.default_model()
    tree = html.Tree(html.parse("<body><nav><a href=x>Home</a></nav><article><h1>Title here.</h1><p>Some words of it.</p></article><footer>&copy; x</footer></body>"))
    n = len(tree.nodes)
    total, marginal = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        s = sum(model.unary.get(f, 0.0) for k in range(n) if y[k] for f in tree.feats[k]) + sum(model.edges[tree.kinds[k]][y[tree.up[k]]][y[k]] for k in range(n) if tree.kinds[k] and tree.kinds[k] in model.edges)
        total += np.exp(s)
        marginal += np.exp(s) * np.array(y)
    assert model.marginals(tree)[0] == pytest.approx((marginal / total).tolist(), abs=1e-6)


def test_markup_that_is_not_well_formed():
    model = html.default_model()
    page = '<html><head><title>T</title><script>if (a < b) "</p>";</script></head><body><nav><a href="/x">Menu</a></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1><p><b>One<br>two<p>Th&eacute; &#233;nd&nbsp;of it, as it were.<ul><li>first item<li>second</ul></article><footer>&copy; me'
    assert html.main_text(page, model) == "A & B\nOne two\nThé énd of it, as it were.\nfirst item\nsecond"
    assert html.main_text("", model) == "" and html.main_text("<p", model) == ""


def test_main_text_of_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Words of a text that is long enough to be one.</p></article>"), (3, "u", "<p>" * 3_000 + "deep"), (3, "u", "<p>" * 3_000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["n_chars"] for r in html.extract(pages).where("page_id < 3").orderBy("page_id").collect()] == [0, 0]
    assert html.extract(pages).count() == 5 and html.extract(pages.limit(0)).count() == 0
    clash = pages.selectExpr("page_id", "html", "'old' as text", "1.5 as n_chars", "'kept' as label")
    rows = html.extract(clash).where("page_id is null").collect()
    assert rows[0]["text"] == "Words of a text that is long enough to be one." and rows[0]["n_chars"] == 46 and rows[0]["label"] == "kept"


def test_pipeline_keeps_what_plain_stages_keep(spark):
    import corpus_pipeline
    from tidemark.llm import decontam

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == {r["doc_id"] for r in kept.select("doc_id").collect()}
    for r in kept.collect():
        assert out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.find_contamination(kept, bench).where("n_hit > 0").count() == 0
    assert neardup.near_duplicates(kept).where("not kept").count() == 0
    rest = {r["doc_id"]: r["text"] for r in kept.collect()}
    groups = collections.Counter(c for _, c in brute_components(list(rest.items()), 5, 80).values())
    assert max(groups.values()) == 1


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "key", "bands", "n_hit"]
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", "score", F.lit(1).alias("key"), F.lit("b").alias("bands"), F.lit(None).cast("int").alias("n_hit"))
    rated = [(k, 1, 0) for k in (1, 5, 7)] + [(6, 0, 0), (None, 1, 0), (3, None, None)]
    cases = {
        "plain": (docs, rated, [-1, 1, 5, 7]),
        "no_language": (docs.withColumn("lang", F.lit(None).cast("string")), rated, [-1, 1, 5, 7]),
        "no_ratings": (docs, [], [-1, 1, 5, 7]),
        "no_rows": (docs.limit(0), rated, []),
    }
    for name, (table, ratings, want) in cases.items():
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(ratings, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "entirely other words"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:4] if name == "plain" else ():
            kept = stage(spark, kept, folder)
            assert kept.columns == names, (name, step)
        out = corpus_pipeline.run(spark, folder)
        assert sorted(r["doc_id"] or -1 for r in out.collect()) == want, name
