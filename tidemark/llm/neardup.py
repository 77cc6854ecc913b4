"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

A document's set is its distinct shingles of `n` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a document of fewer words has one
shingle, all of them. Two documents are linked if the Jaccard index of their sets is at least `percent` / 100.

1. A scan gives each document a 128-bit hash of its set and a signature: 16 bits of each of its minima under many universal hash
   functions. A band is `rows` minima; there are as many bands as make a link at the threshold be missed with a chance of
   at most `MISS`, which with the comparison of signatures stays within it. Band keys are hashes of the signature's parts, made when they are needed.
2. Documents with equal sets are one class, a node of its own; so groups of copies count once, and signatures go on once a class.
3. In each bucket (classes with equal band keys) every class is paired with one leader only, the one that shares most buckets with others. Pairs that pass
   the comparison of lengths and signatures are confirmed on the full sets; components follow by large-star and small-star.
4. A bucket whose classes are then all of one component is settled, and so is one of two classes. In others, classes outside the leader's component are
   compared with all others of fitting lengths by blocks of about `BLOCK` classes, dealt over the cluster, so that no link is lost and no group
   meets in one task. A pair is compared in the first bucket it shares. The blocks hold signatures only; texts go to those
   members whose signatures are like another's. They are confirmed there, and only links that join components leave the task; the
   components are then completed.

Only keys, signatures and the texts of candidate pairs are shuffled; nothing of the corpus reaches the driver. What is written
to the shared folder on the way is deleted when the result is written.

Defined results: a text that is null or has no words has the empty set, is linked with nothing and is its own component; rows
that share an id are judged each by its own text; a null id is answered with a null component and kept;
an empty table gives an empty result; other columns do not matter, whatever their names. `drop_near_duplicates` leaves one row of each component:
of the smallest id, and one of those that have this id and the same set too; rows without words or without an id all stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.components import components
from tidemark.llm.textkit import GRAPHIC, Words, mix, scan, words_of
from tidemark.shared import Scratch

ROWS, MISS = 5, 1e-6
#: Members of a block, and the shingles they may have together.
BLOCK, WEIGHT = 512, 1 << 18
#: Up to so many ids or decisions are broadcast, so that only the texts of candidates are shuffled; of more, both sides are.
BROADCAST_ROWS = 1_000_000
FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("sig", T.BinaryType())]


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The least number of bands that misses a pair at the threshold with a chance of at most MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - min(0.999999, (percent / 100) ** rows))))


def least_equal(percent: int, bands: int) -> int:
    """The most equal minima that can be asked of a pair so that this and the bands together miss one at the threshold with a chance of at most MISS."""
    share, count = min(0.999999, percent / 100), bands * ROWS
    left, k = MISS - (1 - share**ROWS) ** bands, 0
    while k < count:
        left -= math.exp(math.lgamma(count + 1) - math.lgamma(k + 1) - math.lgamma(count - k + 1) + k * math.log(share) + (count - k) * math.log1p(-share))
        if left < 0:
            break
        k += 1
    return k


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, sorted by row and hash."""
    counts, grams, whole = words.counts(), words.grams(n), words.whole(n)
    value, row = grams[whole], words.row[: len(grams)][whole]
    for size in range(1, n):  # all words of a short document
        at = words.first[:-1][counts == size]
        if len(at):
            value, row = np.concatenate([value, words.grams(size)[at]]), np.concatenate([row, words.row[at]])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[first], row[first]


def signatures(n: int, bands: int):
    """n_shingles, the two halves of the set's hash and, if there are bands, the signature of each text."""

    def make():
        scale, shift = _functions(ROWS * bands)

        def work(column: pa.Array) -> list[pa.Array]:
            sizes, keys, keys2, sigs = [], [], [], []
            for _, _, words in words_of(column, GRAPHIC):
                value, row = _sets(words, n)
                size = np.bincount(row, minlength=words.rows).astype(np.int64)
                full = np.flatnonzero(size)
                starts = np.searchsorted(row, full)
                hashes = [np.add.reduceat(h, starts).astype(np.int64) if len(full) else np.zeros(0, np.int64) for h in (mix(value), mix(value ^ np.uint64(0x5851F42D4C957F2D)))]
                place = np.full(words.rows, -1)
                place[full] = np.arange(len(full))
                some = pa.array(place, mask=place < 0)
                sizes.append(pa.array(size))
                keys.append(pa.array(hashes[0]).take(some))
                keys2.append(pa.array(hashes[1]).take(some))
                if bands:
                    minima = np.empty((len(full), len(scale)), np.uint16)
                    for k in range(len(scale)) if len(full) else ():  # the upper bits of minima are small numbers, so they are scrambled first
                        minima[:, k] = mix(np.minimum.reduceat(value * scale[k] + shift[k], starts)).astype(np.uint16)
                    sigs.append(pa.array([x.tobytes() for x in minima], pa.binary()).take(some))
            join = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], kind)
            made = [join(sizes, pa.int64()), join(keys, pa.int64()), join(keys2, pa.int64())]
            return [*made, join(sigs, pa.binary())] if bands else made

        return work

    return make


def _bands(sig: np.ndarray) -> np.ndarray:
    """Band keys of signatures, rows x bands."""
    parts = sig.reshape(len(sig), -1, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        acc = mix(acc << np.uint64(16) ^ parts[:, :, k] ^ acc >> np.uint64(48))
    return acc


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1) if len(column) else np.zeros((0, ROWS), np.uint16)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, signature) to (bucket, node, size) for each band."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = _bands(_signatures_of(part.column(2)))
            again = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), part.column(0).take(again), part.column(1).take(again)], names=["bucket", "node", "size"])


def shingles(text: str | None, n: int) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def _confirm(n: int, percent: int):
    """Of (u, v, text of u, text of v) the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(batch.num_rows):
                one = known.get(u[k])
                if one is None:  # pairs of one leader tend to come together
                    known = {u[k]: (one := shingles(batch.column(2)[k].as_py(), n))}
                two = shingles(batch.column(3)[k].as_py(), n)
                common = len(one & two)
                if common and 100 * common >= percent * (len(one) + len(two) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64())], names=["u", "v"])

    return run


def _alike(least: float):
    """(u, v, signature, signature) to the (u, v) whose signatures agree in that share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            ok = pa.array((a == b).mean(1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return run


class _Block:
    """Members of a block: nodes, components, sizes, sides, signatures and band keys."""

    def __init__(self, members: pa.StructArray):
        self.node, self.comp, self.size, self.left, self.right = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "size", "left", "right"))
        self.sig = _signatures_of(members.field("sig"))

    def pairs(self, bucket: int, least: float, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, likeness) of members of different components that are like each other and meet in no bucket before."""
        bands = _bands(self.sig)
        one, two = np.flatnonzero(self.left), np.flatnonzero(self.right)
        found = []
        for part in np.array_split(one, max(1, len(one) * len(two) // 65_536 + 1)):
            ok = self.comp[part][:, None] != self.comp[two][None, :]
            small, large = np.minimum(self.size[part][:, None], self.size[two][None, :]), np.maximum(self.size[part][:, None], self.size[two][None, :])
            i, j = np.nonzero(ok & (100 * small >= percent * large))
            for at in np.array_split(np.arange(len(i)), len(i) // 16_384 + 1):
                u, v = part[i[at]], two[j[at]]
                alike = (self.sig[u] == self.sig[v]).mean(1)
                near = np.flatnonzero(alike >= least)
                u, v, alike = u[near], v[near], alike[near]
                here = bands[u, (bands[u] == bands[v]).argmax(1)] == np.uint64(bucket & (1 << 64) - 1) if len(u) else np.zeros(0, bool)
                found.append((u[here], v[here], alike[here]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _needed(least: float, percent: int):
    """(bucket, i, j, members) to (bucket, i, j, node) of the members that are in a pair to confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, out = batch.column(0).to_pylist(), [[], [], [], []]
            for k in range(batch.num_rows):
                block = _Block(batch.column(3)[k].values)
                u, v, _ = block.pairs(buckets[k], least, percent)
                nodes = np.unique(np.concatenate([block.node[u], block.node[v]])).tolist()
                for c in range(3):
                    out[c] += [batch.column(c)[k].as_py()] * len(nodes)
                out[3] += nodes
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["bucket", "i", "j", "node"])

    return run


def _across(n: int, least: float, percent: int):
    """(bucket, members with texts) to the links that join components: of each left and right member of different components that pass.

    Pairs are confirmed from the most alike on, on the hashes of all shingles; those of components that meanwhile are one are not
    looked at, so that each task yields fewer links than it has members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            lists, buckets = batch.column(1), batch.column(0).to_pylist()
            for k in range(batch.num_rows):
                members = lists[k].values
                block = _Block(members)
                lefts, rights, alike = block.pairs(buckets[k], least, percent)
                if not len(lefts):
                    continue
                sets = _hashed(members.field("text"), n)
                root = {c: c for c in block.comp.tolist()}

                def find(x: int) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for at in np.argsort(-alike, kind="stable").tolist():
                    u, v = int(lefts[at]), int(rights[at])
                    a, b = find(int(block.comp[u])), find(int(block.comp[v]))
                    if a == b:
                        continue
                    common = len(sets[u] & sets[v])
                    if 100 * common >= percent * (len(sets[u]) + len(sets[v]) - common):
                        root[max(a, b)] = min(a, b)
                        us.append(int(block.node[u]))
                        vs.append(int(block.node[v]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _hashed(texts: pa.Array, n: int) -> list[set]:
    """The sets of texts that have words, by 64-bit hashes of their shingles."""
    out = []
    for _, _, words in words_of(texts, GRAPHIC):
        grams, whole, counts = words.grams(n), words.whole(n), words.counts()
        for row in range(words.rows):
            at, to = int(words.first[row]), int(words.first[row + 1])
            if counts[row] < n:
                out.append({int(x) for x in words.grams(int(counts[row]))[at : at + 1]} if counts[row] else set())
            else:
                out.append(set(grams[at : to - n + 1][whole[at : to - n + 1]].tolist()))
    return out


def _bounded(rows: DataFrame, count: int) -> DataFrame:
    """rows, to be broadcast if they are few enough."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


class _Job:
    """The steps of one search over (id, text); its tables lie in one folder, which goes when the result is written."""

    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int):
        column = lambda c: F.col("`" + c.replace("`", "``") + "`")
        self.source = docs.select(column(key).cast("long").alias("id"), column(text).cast("string").alias("text"))
        self.n, self.percent, self.bands = n, int(percent), bands_for(percent)
        self.least = (least_equal(percent, self.bands) - 0.5) / (self.bands * ROWS)  # a half less, so that rounding excludes no pair
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")

    def run(self) -> None:
        """signed: (id, n_shingles, key, key2) of every row. classes: (key, key2, node, id, copies). final: (node, component)."""
        keep = self.scratch.keep
        wide = keep(scan(self.source, "text", signatures(self.n, self.bands), FIELDS, ["id"]))
        self.signed = wide.drop("sig")
        own = wide.where("id is not null and key is not null").groupBy("key", "key2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
        reps = keep(own.withColumn("node", F.monotonically_increasing_id()))
        self.classes = reps.drop("sig", "size")
        buckets = reps.select("node", "size", "sig").mapInArrow(_buckets, "bucket long, node long, size long")
        shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = keep(buckets.join(shared, "bucket"))
        sums = members.groupBy("node").agg(F.sum("n").alias("ties"))
        leaders = members.join(sums, "node").groupBy("bucket").agg(F.max(F.struct("ties", (-F.col("node")).alias("node"), "size")).alias("best")).select("bucket", (-F.col("best.node")).alias("leader"), F.col("best.size").alias("leader_size"))
        led = keep(members.join(leaders, "bucket"))
        self.scratch.drop(members)
        links = self.stars(reps, led)
        first = components(links, scratch=self.scratch)
        more = self.rest(reps, led, first)
        self.scratch.drop(led)
        joined = more is not None and not more.isEmpty()
        self.final = components(links.union(more), scratch=self.scratch) if joined else first

    def fits(self, one: str, two: str):
        """Whether sets of these sizes can be linked."""
        return F.expr(f"100 * least({one}, {two}) >= {self.percent} * greatest({one}, {two})")

    def stars(self, reps: DataFrame, led: DataFrame) -> DataFrame:
        """Confirmed links of members with the leader of their bucket."""
        pairs = led.where((F.col("node") != F.col("leader")) & self.fits("size", "leader_size")).select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
        one, two = (reps.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "uv")
        near = self.scratch.keep(pairs.join(two, "v").join(one, "u").select("u", "v", "sig_u", "sig_v").mapInArrow(_alike(self.least), "u long, v long"))
        texts = self.texts(near.select(F.col("u").alias("node")).union(near.select("v")).distinct())
        one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
        return self.scratch.keep(near.join(two, "v").join(one, "u").select("u", "v", "text_u", "text_v").mapInArrow(_confirm(self.n, self.percent), "u long, v long"))

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text), a text of each of the nodes."""
        wanted = self.scratch.keep(nodes.join(self.classes, "node").select("node", "id", F.col("key").alias("key_"), F.col("key2").alias("key2_")))
        ids = wanted.select("id").distinct()
        body = self.source.join(_bounded(ids, wanted.count()), "id", "left_semi")
        body = scan(body, "text", signatures(self.n, 0), FIELDS[:3], ["id", "text"])
        same = (body["id"] == wanted["id"]) & (body["key"] == wanted["key_"]) & (body["key2"] == wanted["key2_"])
        return body.join(wanted, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))

    def rest(self, reps: DataFrame, led: DataFrame, first: DataFrame) -> DataFrame | None:
        """In buckets that still hold several components: links of members outside the leader's component with any other."""
        keep = self.scratch.keep
        placed = led.where("n > 2").select("bucket", "node", "size", "leader").join(first, "node", "left").select("bucket", "node", "size", "leader", F.coalesce("component", "node").alias("comp"))
        main = placed.where("node = leader").select("bucket", F.col("comp").alias("main"))
        marked = keep(placed.join(main, "bucket").select("bucket", "node", "size", "comp", (F.col("comp") != F.col("main")).alias("out")))
        bounds = marked.where("out").groupBy("bucket").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.lit(1)).alias("n_out"), F.sum("size").alias("w_out"))
        able = F.expr(f"100 * size >= {self.percent} * low and 100 * high >= {self.percent} * size")  # members of other lengths fit none outside
        kept = keep(marked.join(bounds, "bucket").where(able))
        self.scratch.drop(marked)
        blocks = lambda n, weight: F.ceil(F.greatest(n / F.lit(BLOCK), weight / F.lit(WEIGHT)))
        counts = kept.groupBy("bucket").agg(blocks(F.count(F.lit(1)), F.sum("size")).alias("wide"), blocks(F.max("n_out"), F.max("w_out")).alias("high_"))
        dealt = kept.select("bucket", "node", "size", "comp", "out").join(counts, "bucket")
        block = lambda salt, count: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count))
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
        single = (F.col("wide") == 1) & (F.col("high_") == 1)
        lefts = dealt.where(F.col("out") & ~single).select("bucket", "node", "comp", "size", F.lit(True).alias("left"), F.lit(False).alias("right"), block(7, "high_").alias("i"), every("wide").alias("j"))
        rights = dealt.select("bucket", "node", "comp", "size", (F.col("out") & single).alias("left"), F.lit(True).alias("right"), every("high_").alias("i"), block(8, "wide").alias("j"))
        sides = lefts.unionByName(rights).join(reps.select("node", "sig"), "node")

        def grouped(rows: DataFrame, *columns: str) -> DataFrame:
            return rows.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("node", "comp", "size", "left", "right", "sig", *columns)).alias("members"))

        needed = keep(grouped(sides).select("bucket", "i", "j", "members").mapInArrow(_needed(self.least, self.percent), "bucket long, i long, j long, node long"))
        if needed.isEmpty():
            return None
        found = sides.join(needed, ["bucket", "i", "j", "node"], "left_semi").join(self.texts(needed.select("node").distinct()), "node")
        return keep(grouped(found, "text").select("bucket", "members").mapInArrow(_across(self.n, self.least, self.percent), "u long, v long"))

    def named(self) -> DataFrame:
        """(key, key2, id, node, component_id, head) of every class: the smallest id in its component, and whether it is the first node with it."""
        tied = self.classes.join(self.final, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = tied.groupBy("component").agg(F.min(F.struct("id", "node")).alias("head"))
        return tied.join(heads, "component").select("key", "key2", "id", "copies", F.col("head.id").alias("component_id"), (F.col("node") == F.col("head.node")).alias("head"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row for each of docs; kept if its id is the smallest of its component."""
    job = _Job(docs, key, text, n, percent)
    job.run()
    worded = F.col("id").isNotNull() & F.col("key").isNotNull()
    known = job.signed.where(worded).join(job.named().select("key", "key2", "component_id"), ["key", "key2"]).select("id", "n_shingles", "component_id")
    alone = job.signed.where(~worded).select("id", "n_shingles", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return job.scratch.finish(known.unionByName(alone).select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept")))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with their own columns, that stand for their component."""
    job = _Job(docs, key, text, n, percent)
    job.run()
    # Rows to go by (id, set): those of other classes or ids than the component's head. Of several rows with its id and set one stays.
    heads = job.named().where("head").select("key", "key2", F.col("id").alias("id_"))
    times = job.signed.where("id is not null and key is not null").groupBy("id", "key", "key2").agg(F.count(F.lit(1)).alias("n"))
    judged = times.join(heads, ["key", "key2"], "left").select("id", "key", "key2", "n", F.coalesce(F.col("id") == F.col("id_"), F.lit(False)).alias("stays"))
    judged = job.scratch.finish(judged.where("not stays or n > 1").select(*(F.col(c).alias(f"__{c}") for c in ("id", "key", "key2", "stays"))))
    judged = _bounded(judged, judged.count())
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(x) for c, x in own.items()))
    keyed = scan(renamed, own[text], signatures(n, 0), FIELDS[:3], list(own.values()))
    same = (keyed[own[key]].cast("long") == judged["__id"]) & (keyed["key"] == judged["__key"]) & (keyed["key2"] == judged["__key2"])
    names = [F.col(x).alias(c) for c, x in own.items()]
    once = keyed.join(judged, same, "left_anti").select(*names)
    repeated = judged.where("__stays")
    if repeated.isEmpty():
        return once
    return once.union(keyed.join(repeated, same, "left_semi").dropDuplicates([own[key], "key", "key2"]).select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i : i + least(len(ws), 3) - 1], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from common join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 85 * (a.n + b.n - k)),
both_ways as (select u, v from links union all select v, u from links),
reach(doc_id, c) as (select doc_id, doc_id from w union select r.doc_id, b.v from reach r join both_ways b on b.u = r.c)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, min(c) as component_id, w.doc_id = min(c) as kept
from w left join n using (doc_id) join reach using (doc_id) group by w.doc_id, n
"""
