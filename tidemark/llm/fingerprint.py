"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the weighted set of its terms, the runs of characters that are not white space in lower case, weighted by
their counts. For each of `samples` functions every term draws r and c from Gamma(2, 1) and b from [0, 1), all from hashes of the term; with weight w

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1),

and the term of least a is the sample, together with its t. Two texts have the same sample with a probability that equals
their generalised Jaccard index, sum of min(w) / sum of max(w), so that the share of equal samples estimates it with a
standard error of at most 0.5 / sqrt(samples).

a is carried as the upper half of a number of which the lower half is a hash of (term, t); the least number is
the sample, and 32 bits of it, in hexadecimal, are written in the fingerprint.

Texts stand in one shuffle only, dealt by ranges of ids (`ranges`): counts, samples and the comparison with the neighbour
follow inside these ranges.

Defined results: a null text is an empty one; a text without terms has an empty fingerprint, and is like another without terms (1.0) but
like no other (0.0); null ids come after all others, and rows that share an id in the order of their texts; one document
alone is its own neighbour; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
SCALE = 1 << 23


def _constant(k: int) -> int:
    """A 64-bit number for each function, from the golden ratio."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 % (1 << 64)
    return x - (1 << 64) if x >= 1 << 63 else x


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The number of a term (a 64-bit hash) with that logarithm of its weight under function k.

    ln a is above -100, as ln c is at least -23, r at most 31 and ln w below 44, and at most 4.
    """
    one, two = (F.xxhash64(term.bitwiseXOR(F.lit(_constant(2 * k + j)))) for j in (0, 1))
    unit = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(0.5**bits)
    r = -F.ln(unit(one, 0, 21) * unit(one, 21, 21))
    b = unit(one, 42, 21)
    log_c = F.ln(-F.ln(unit(two, 0, 32) * unit(two, 32, 32)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + F.lit(1.0))
    place = F.floor((log_a + F.lit(128.0)) * F.lit(float(SCALE)))
    return F.shiftleft(place, 31).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << 31) - 1)))


def _words(text: str) -> Column:
    return F.explode(F.split(F.lower(text), r"[\x09-\x0D ]+")).alias("__term")


def _least(counted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys with s0, s1, ...: the least number of a key's terms (__term, a hash, with __w, the logarithm of its count) under each function."""
    return counted.groupBy(*keys).agg(*(F.min(sample(F.col("__term"), F.col("__w"), k)).alias(f"s{k}") for k in range(samples)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys with s0, s1, ... of every row that has terms. If texts are dealt by a subset of keys, nothing is shuffled."""
    terms = texts.select(*keys, _words(text)).where("__term <> ''")
    counted = terms.groupBy(*keys, F.xxhash64("__term").alias("__term")).agg(F.ln(F.count(F.lit(1)).cast("double")).alias("__w"))
    return _least(counted, keys, samples)


def paired_fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys with own and other, the arrays of samples of two texts of each key (which: 0 and 1); null without terms.

    The samples of the terms that both have equally often are drawn once: the least of a text is the lesser one of those and of what it has alone.
    """
    terms = texts.select(*keys, "which", _words("text")).where("__term <> ''")
    times = (F.count_if(F.col("which") == w).alias(c) for w, c in ((0, "__own"), (1, "__other")))
    counted = terms.groupBy(*keys, F.xxhash64("__term").alias("__term")).agg(*times)
    part = lambda w, n: F.struct(F.lit(w).alias("part"), F.col(n).alias("n"))
    parts = F.when(F.col("__own") == F.col("__other"), F.array(part(2, "__own"))).otherwise(F.array(part(0, "__own"), part(1, "__other")))
    split = counted.select(*keys, "__term", F.explode(parts).alias("x")).where("x.n > 0").select(*keys, "__term", F.col("x.part").alias("part"), F.ln(F.col("x.n").cast("double")).alias("__w"))
    drawn = _least(split, [*keys, "part"], samples).select(*keys, "part", F.array(*(f"s{k}" for k in range(samples))).alias("samples"))
    each = drawn.groupBy(*keys).agg(*(F.max(F.when(F.col("part") == w, F.col("samples"))).alias(c) for w, c in ((0, "own"), (1, "other"), (2, "both"))))
    lesser = lambda c: F.coalesce(F.zip_with(c, "both", lambda a, b: F.least(a, b)), F.col(c), F.col("both")).alias(c)
    return each.select(*keys, lesser("own"), lesser("other"))


def text_of(samples: Column) -> Column:
    """The fingerprint of an array of samples: eight hexadecimal digits of each; empty without terms."""
    digits = F.transform(samples, lambda c: F.lpad(F.lower(F.hex(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(one: Column, two: Column) -> Column:
    """Share of equal samples of two arrays; two sets without terms (null) are alike."""
    equal = F.aggregate(F.zip_with(one, two, lambda a, b: (a == b).cast("int")), F.lit(0), lambda total, x: total + x)
    return F.when(one.isNotNull() & two.isNotNull(), equal / F.size(one)).when(one.isNull() & two.isNull(), 1.0).otherwise(0.0)


#: Cuts that are searched one by one; more ranges are made by dividing each stretch between two evenly.
CUTS = 2048


def _numbers(values: list[int]) -> Column:
    """An array of whole numbers as one literal, however many there are; the plan does not grow by an expression for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _search(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value, by halving steps."""
    if not cuts:
        return F.lit(0)
    steps, known = [1 << k for k in reversed(range(len(cuts).bit_length()))], _numbers(cuts)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= value, at + step).otherwise(at))


def _range_of(rows: DataFrame, ranges: int) -> Column:
    """A number of the range of ids that a row's id is in, larger for larger ids; null ids are below all."""
    wanted = min(ranges, CUTS)
    found = rows.where("id is not null").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.percentile_approx("id", [k / wanted for k in range(1, wanted)], 10 * wanted).alias("cuts") if wanted > 1 else F.lit(None).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or []))
    stretch = _search(F.col("id"), cuts)
    divide = -(-ranges // CUTS)
    if divide > 1 and cuts:
        ends = _numbers([found["low"], *cuts, found["high"]])
        low, high = F.element_at(ends, stretch + 1).cast("double"), F.element_at(ends, stretch + 2).cast("double")
        share = F.coalesce(F.try_divide(F.col("id") - low, high - low), F.lit(0.0))  # ids that are one double, or the largest alone, stay together
        stretch = stretch * divide + F.least(F.floor(share * divide), F.lit(divide - 1)).cast("int")
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(stretch).cast("int")


def with_neighbour(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(bucket, place, ghost, id, text, next): each row with the text of the next one by descending id, the last with the first's.

    Rows are dealt by ranges of ids, so that one shuffle serves all that follows by (bucket, place). The rows of the largest id of each
    range stand once more, as ghosts, at the end of the range above it, those of the topmost at the end of the lowest. Only one
    id for each range reaches the driver.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = rows.withColumn("bucket", _range_of(rows, ranges or 8 * parts))
    heads = {r["bucket"]: r["top"] for r in placed.groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    order = sorted(heads, reverse=True)
    tops, targets = ([0] * (max(order, default=-1) + 2) for _ in range(2))
    for i, b in enumerate(order):
        tops[b + 1], targets[b + 1] = heads[b] or 0, order[i - 1]
    is_head = F.col("id").isNull() | (F.col("id") == F.get(_numbers(tops), F.col("bucket") + 1))
    target = F.get(_numbers(targets), F.col("bucket") + 1)
    own, ghost = (F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("ghost")) for b, g in ((F.col("bucket"), False), (target, True)))
    dealt = placed.select("id", "text", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))).alias("x")).select("x.bucket", "x.ghost", "id", "text").where("bucket is not null").repartition(parts, "bucket")
    line = Window.partitionBy("bucket").orderBy("ghost", F.col("id").desc_nulls_last(), "text")
    return dealt.select("bucket", F.row_number().over(line).alias("place"), "ghost", "id", "text", F.lead("text").over(line).alias("next"))


def compare_with_edited(docs: DataFrame, *, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document by descending id.
    """
    rows = with_neighbour(docs, key=key, text=text)
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("next", "text"), F.lit(1), half)))
    variants = F.array(*(F.struct(F.lit(w).alias("which"), F.col(c).alias("text")) for w, c in ((0, "text"), (1, "edited"))))
    pairs = rows.select("bucket", "place", F.explode(variants).alias("x")).select("bucket", "place", "x.which", "x.text")
    each = paired_fingerprints(pairs, ["bucket", "place"], samples)
    facts = rows.select("bucket", "place", "ghost", "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    line = Window.partitionBy("bucket").orderBy("place")
    both = facts.join(each, ["bucket", "place"], "left").withColumn("after", F.lead("own").over(line)).where("not ghost")
    return both.select(F.col("id").alias(key), "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
