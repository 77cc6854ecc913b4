"""License scans by an exact set-similarity join, in DataFrame functions only.

Words are the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A text block is a window of two strides of words, one
every stride, so that whatever is at most a stride long lies in a block whole. The stride is `STRIDE` words, doubled until it holds the template, so that
templates may have any length. A template is in a block if the block holds at least
`percent` of its distinct words; the join finds every such pair:

* words are ordered by their frequency in the whole corpus, the rarest first;
* a template of m words that must share k of them is sought only by its m - k + 1 rarest words (prefix filter);
* blocks with fewer than k template words are left out (length filter);
* a pair whose first common prefix word leaves fewer than k words in the template or the block is left out (positional filter);
* for the rest the common words are counted.

The corpus is taken apart once: each text's number of words and the places of words that templates have are written to the shared folder, and all else reads
those. A text without a prefix word of any template holds none, so only the others go on. The templates and the counts of their words are all that reaches the driver.

Phrases are templates of which a block must hold every word; what the join finds is then checked for places where the words stand
consecutively. Of templates so alike that the words of one are enough for the other (versions of a license) only those of the largest
share in a block give their label; every other template that a block holds gives its own, whatever else is in the block.

Defined results: a null, empty or wordless text has no words, places or labels, and score 0; repeated rows are each answered; an empty
table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE, PERCENT = 40, 85

# Phrases with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Wording of well-known public licenses and notices.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    ("gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "cc0"),
]


def needed(m: int, percent: int) -> int:
    """How many of m words are at least that percentage."""
    return -(-m * percent // 100)


def rivals(sets: list[tuple[list[int], int]]) -> list[list[int]]:
    """For each (words, needed words) the others that are needed with words of it alone, or the other way round."""
    return [[j for j, (two, l) in enumerate(sets) if j != i and (common := len(set(one) & set(two))) and (common >= l or common >= k)] for i, (one, k) in enumerate(sets)]


def stride_for(words: int) -> int:
    """STRIDE, doubled until it holds so many words."""
    stride = STRIDE
    while stride < words:
        stride *= 2
    return stride


def find_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score): one row for each of docs."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    sets = [(p.split(), label, True, 100) for p, label in phrases] + [(t.split(), label, False, percent) for t, label in templates]
    vocabulary = sorted({w for words, *_ in sets for w in words})
    low = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))
    places = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    known = F.filter(places, lambda x: x["word"].isin(vocabulary)) if vocabulary else F.slice(places, 1, 0)
    taken = scratch.keep(rows.select("id", F.size("words").cast("long").alias("n_words"), known.alias("places")).withColumn("row", F.monotonically_increasing_id()))

    # Frequency of the templates' words in the corpus, and ranks by it.
    counts = {r["word"]: r["n"] for r in taken.select(F.explode("places.word").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index, whole = [], []
    for number, (words, label, base, share) in enumerate(sets):
        ranks = sorted({rank[w] for w in words})
        k, stride = needed(len(ranks), share), stride_for(len(words))
        whole.append((number, label, base, ranks, len(ranks), k))
        index += [(r, stride, i, number) for i, r in enumerate(ranks[: len(ranks) - k + 1])]
    against = rivals([(w[3], w[5]) for w in whole])
    whole = [(*w, against[w[0]]) for w in whole]
    prefix = [order[r] for r in sorted({r for r, *_ in index})]
    if not index:
        return scratch.finish(_finish(taken.select("id", "n_words"), key))

    sought = F.exists("places", lambda x: x["word"].isin(prefix))
    ranks = F.broadcast(spark.createDataFrame(list(rank.items()), "word string, rank int"))  # bounded by the templates
    tokens = taken.where(sought).select("row", F.explode("places").alias("x")).select("row", "x.pos", "x.word").join(ranks, "word").drop("word")

    # Blocks against templates.
    def blocks_at(stride: int):
        here = (F.col("pos") / stride).cast("int")
        block = lambda n: F.struct(F.lit(stride).alias("stride"), n.alias("block"))
        return F.when(here > 0, F.array(block(here), block(here - 1))).otherwise(F.array(block(here)))

    strides = sorted({stride for _, stride, *_ in index})
    blocks = tokens.select("row", F.explode(F.flatten(F.array(*map(blocks_at, strides)))).alias("b"), "rank").select("row", "b.stride", "b.block", "rank")
    blocks = blocks.groupBy("row", "stride", "block").agg(F.array_sort(F.collect_set("rank")).alias("have"))
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, stride int, i int, template int"))  # bounded by the templates
    full = F.broadcast(spark.createDataFrame(whole, "template int, label string, base boolean, want array<int>, m int, k int, rivals array<int>"))
    where = ["row", "stride", "block"]
    pairs = blocks.where(F.size("have") >= min(w[5] for w in whole)).select(*where, "have", F.posexplode("have").alias("j", "rank")).join(prefixes, ["rank", "stride"])
    pairs = pairs.groupBy(*where, "template").agg(F.min(F.struct("i", "j")).alias("first"), F.first("have").alias("have")).join(full, "template")
    fits = pairs.where((F.size("have") >= F.col("k")) & (F.lit(1) + F.least(F.col("m") - 1 - F.col("first.i"), F.size("have") - 1 - F.col("first.j")) >= F.col("k")))
    found = fits.withColumn("common", F.size(F.array_intersect("have", "want"))).where("common >= k").select(*where, "template", "label", "base", "rivals", (F.col("common") / F.col("m")).alias("share"))
    found = scratch.keep(found)
    beside = F.collect_list(F.struct("template", "share")).over(Window.partitionBy(*where))
    beaten = F.exists("beside", lambda x: F.array_contains("rivals", x["template"]) & (x["share"] > F.col("share")))
    extra = found.where("not base").withColumn("beside", beside).where(~beaten).groupBy("row").agg(F.collect_set("label").alias("extra"), F.max("share").alias("share"))

    # Places of phrases in the documents where the join found all their words together.
    spoken = [(number, [rank[w] for w in words], label) for number, (words, label, base, _) in enumerate(sets) if base]
    line = Window.partitionBy("row").orderBy("pos")
    longest = max((len(p) for _, p, _ in spoken), default=1)
    ahead = tokens.join(found.where("base").select("row").distinct(), "row", "left_semi").select("row", "pos", "rank", *(F.lead(c, d).over(line).alias(f"{c}{d}") for d in range(1, longest) for c in ("pos", "rank")))
    tests = []
    for number, p, label in spoken:
        hit = F.col("rank") == p[0]
        for d, r in enumerate(p[1:], 1):
            hit &= (F.col(f"rank{d}") == r) & (F.col(f"pos{d}") == F.col("pos") + d)
        tests.append(F.when(hit, F.struct(F.lit(number).alias("template"), F.lit(label).alias("label"))))
    said = ahead.select("row", "pos", F.explode(F.array_compact(F.array(*tests) if tests else F.array().cast("array<struct<template:int,label:string>>"))).alias("x")).select("row", "pos", "x.template", "x.label")
    said = said.join(found.where("base").select("row", "template").distinct(), ["row", "template"], "left_semi")
    base = said.groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"), F.collect_set("label").alias("base"))
    return scratch.finish(_finish(taken.select("row", "id", "n_words").join(base, "row", "left").join(extra, "row", "left").drop("row"), key))


def _finish(rows: DataFrame, key: str) -> DataFrame:
    for c, kind in (("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base", "array<string>"), ("extra", "array<string>"), ("share", "double")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    none = F.array().cast(T.ArrayType(T.StringType()))
    base, extra = F.coalesce("base", none), F.coalesce("extra", none)
    return rows.select(
        F.col("id").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, extra)), ",").alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ",\n  ".join(f"({k}, '{label}', {quoted(sorted(set(t.split())))})" for k, (t, label) in enumerate(TEMPLATES))
    phrases = ",\n  ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES)
    return rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
t(template, label, want) as (values
  {templates}),
p(label, phrase) as (values
  {phrases}),
places as (
  select doc_id, label, i from (select doc_id, ws, label, phrase, unnest(range(0, len(ws))) as i from w, p) where ws[i + 1 : i + len(phrase)] = phrase),
base as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as base from places group by 1),
blocks as (
  select doc_id, b, list_distinct(ws[b * {STRIDE} + 1 : b * {STRIDE} + {2 * STRIDE}]) as have from (select doc_id, ws, unnest(range(0, (len(ws) + {STRIDE - 1}) // {STRIDE})) as b from w)),
fits as (
  select doc_id, b, template, label, len(list_intersect(have, want)) / len(want) as share from blocks, t where len(list_intersect(have, want)) * 100 >= len(want) * {PERCENT}),
rivals as (
  select x.template as one, y.template as two from t x, t y
  where x.template <> y.template and len(list_intersect(x.want, y.want)) * 100 >= least(len(x.want), len(y.want)) * {PERCENT}),
best as (
  select doc_id, label, share from fits f where not exists (
    select 1 from fits g, rivals where one = f.template and two = g.template and g.doc_id = f.doc_id and g.b = f.b and g.share > f.share)),
extra as (select doc_id, list(distinct label) as extra, max(share) as share from best group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(extra, [])))), ',') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end as score
from w left join base using (doc_id) left join extra using (doc_id)
"""


SQL = _sql()
