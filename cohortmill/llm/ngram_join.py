"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts whose sets of five-word shingles reach a Jaccard similarity of 0.8 are linked.

1. *Sketch.* Each text gives MinHash values in bands. Texts with equal shingle sets form one
   class; from here on the class's smallest id stands for it, so copies cost nothing more.
2. *Candidates.* Classes that share a band are candidates. Two texts at the threshold share at
   least one of 40 bands of 6 values with probability 1 - 5e-6, closer ones more surely. Every
   bucket ties its members to its smallest one, and the components of these ties hold all
   candidate pairs; no pairs are written.
3. *Compare.* The texts that must meet form units: a whole component, or, where a component is
   large and its buckets ask for fewer comparisons, each of its buckets, buckets of the same texts
   once. The sketches and shingles of a unit meet in one task, or, for a large unit, in blocks
   bounded by texts and by shingles, and only blocks whose set sizes allow the threshold meet.
   Ranges of equal row counts deal the meetings to tasks.
   Inside, MinHash values are compared step by step: with m equal among n, the posterior of the
   similarity (uniform prior) is Beta(1 + m, 1 + n - m), and a pair is dropped once the
   probability of reaching the threshold falls below the tolerance. The rest is counted exactly;
   in the bucket of a band only pairs that have no earlier band in common.
   A task returns per text its number of links and a root it is tied to, never the pairs.
4. *Groups.* The ties of all tasks are joined to groups.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import stored
from cohortmill.llm.components import components
from cohortmill.session import broadcast_if_small

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, 128, HASHES)
TOLERANCE = 1e-6
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
MEETING = ("unit", "band", "one", "two")
MEMO = 300_000
WORD = re.compile(r"\w+")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words (lower case letters, digits and
    underscore). A text of fewer words is one shingle; a text without words has none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + count]
    return np.unique(mixed(total))


@lru_cache(maxsize=1)
def hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, HASHES, dtype=np.uint32))


def minhashes(values: np.ndarray) -> np.ndarray:
    """The smallest of ``a * x + b`` over the set, for every hash of the family."""
    a, b = hash_family()
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        least = np.minimum(least, (short[None, at:at + 1024] * a[:, None] + b[:, None]).min(axis=1))
    return least


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, class_key, bands)."""
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("class_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids, keys, bands = part.column("doc_id").to_pylist(), [], []
            for doc_id, text in zip(ids, part.column("text")):
                values = shingles(text.as_py(), width)
                if len(values):
                    keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                    bands.append(band_keys(minhashes(values)))
                else:
                    keys.append(b"%d" % doc_id)
                    bands.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                schema=schema)


def contents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, size, signature, shingles)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(t.as_py(), width) for t in part.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "size": pa.array([len(s) for s in sets], pa.int64()),
                "signature": pa.array([minhashes(s).tobytes() for s in sets], pa.binary()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


@lru_cache(maxsize=8)
def least_equal(threshold: float, tolerance: float) -> dict[int, int]:
    """Per number n of compared values, the fewest equal ones that keep a pair.

    P(similarity >= t | m of n equal) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    needed = {}
    for n in STEPS:
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        needed[n] = m
    return needed


def common_counts(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray
                  ) -> np.ndarray:
    """Exact sizes of the intersections left[i] and right[j]."""
    if len(i) <= 2 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True))
                         for a, b in zip(i, j)], np.int64)
    rows = left + right
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values, column = np.unique(np.concatenate(rows), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((len(left), len(right)), np.int64)
    wide = 8192
    cuts = np.searchsorted(column, np.arange(0, len(values) + wide, wide))
    for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        dense = np.zeros((len(rows), wide), np.float32)
        dense[owner[lo:hi], column[lo:hi] - part * wide] = 1
        counts += np.rint(dense[:len(left)] @ dense[len(left):].T).astype(np.int64)
    return counts[i, j]


def first_common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band that rows of signatures have in common, ``BANDS`` where there is none."""
    same = (left.reshape(-1, BANDS, ROWS) == right.reshape(-1, BANDS, ROWS)).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


def links(a: dict, b: dict | None, threshold: float, tolerance: float, band: int = -1
          ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked texts between two blocks, or within one; from band 0 on, of texts whose
    first common band it is."""
    other = b or a
    share = Fraction(str(threshold))
    p, q = share.numerator, share.denominator
    small = np.minimum(a["size"][:, None], other["size"][None, :])
    large = np.maximum(a["size"][:, None], other["size"][None, :])
    possible = (small * q >= large * p) & (a["id"][:, None] != other["id"][None, :])
    if b is None:
        possible = np.triu(possible, 1)
    i, j = np.nonzero(possible)
    needed, equal, done = least_equal(threshold, tolerance), np.zeros(len(i), np.int64), 0
    for n in STEPS:
        equal += (a["signature"][i, done:n] == other["signature"][j, done:n]).sum(axis=1)
        keep = equal >= needed[n]
        i, j, equal, done = i[keep], j[keep], equal[keep], n
    if band >= 0 and len(i):
        own = np.concatenate([first_common(a["signature"][i[k:k + 4096]], other["signature"][j[k:k + 4096]]) == band
                              for k in range(0, len(i), 4096)])
        i, j = i[own], j[own]
    if len(i):
        common = common_counts(a["shingles"], other["shingles"], i, j)
        exact = common * (p + q) >= p * (a["size"][i] + other["size"][j])
        i, j = i[exact], j[exact]
    return i, j


def roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per index the smallest index it is connected to."""
    label = np.arange(count)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def compare(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float
            ) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (unit, band, one, two) to (doc_id, links, root): blocks ``one`` and ``two``."""
    key, rows = None, []

    def block(rows):
        return {"id": np.array([r[1] for r in rows], np.int64), "size": np.array([r[2] for r in rows], np.int64),
                "signature": np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, HASHES),
                "shingles": [np.frombuffer(r[4], np.uint64) for r in rows]}

    def settle():
        if len(rows) < 2:
            return None
        rows.sort(key=lambda r: r[1])
        _, band, one, two = key
        if one == two:
            a, b = block(rows), None
            i, j = links(a, None, threshold, tolerance, band)
            ids = a["id"]
        else:
            first, second = [r for r in rows if r[0] == one], [r for r in rows if r[0] == two]
            if not first or not second:
                return None
            a, b = block(first), block(second)
            i, j = links(a, b, threshold, tolerance, band)
            ids, j = np.concatenate([a["id"], b["id"]]), j + len(first)
        if not len(i):
            return None
        counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        linked = np.flatnonzero(counts)
        return pa.RecordBatch.from_pydict({"doc_id": ids[linked], "links": counts[linked],
                                           "root": ids[roots(len(ids), i, j)][linked]})

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (*MEETING, "block", "doc_id", "size")]
        signatures, sets = batch.column("signature"), batch.column("shingles")
        for at, (unit, band, one, two, own, doc_id, size) in enumerate(zip(*columns)):
            if (unit, band, one, two) != key:
                if (out := settle()) is not None:
                    yield out
                key, rows = (unit, band, one, two), []
            rows.append((own, doc_id, size, signatures[at].as_py(), sets[at].as_py()))
    if key is not None and (out := settle()) is not None:
        yield out


def units_of(banded: DataFrame, buckets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc_id, units): the units (unit, band) in which a text is compared, at most one per band.

    A component (``clusters``: doc_id, cluster) is one unit, band -1, unless it has more than
    ``BLOCK`` texts and comparing within its buckets takes less than half of its pairs. Then its
    units are its buckets; of buckets with the same texts the one of the first band stands for
    all, so the first band that two texts have in common is always a unit.
    """
    own = (buckets.join(broadcast_if_small(clusters.withColumnRenamed("doc_id", "pivot")), "pivot")
           .groupBy("cluster", "pivot", "n", "mark").agg(F.min("at").alias("at"), F.min_by("band", "at").alias("band")))
    pairs = own.groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    sparse = (clusters.groupBy("cluster").agg(F.count("*").alias("texts")).where(F.col("texts") > BLOCK)
              .join(pairs, "cluster").where(2 * F.col("pairs") < F.col("texts").cast("double") * F.col("texts")))
    sparse = broadcast_if_small(sparse.select("cluster"))
    texts = broadcast_if_small(clusters.join(sparse, "cluster", "left_semi").select("doc_id"))
    chosen = broadcast_if_small(own.join(sparse, "cluster", "left_semi").select("band", "at"))
    many = (banded.join(texts, "doc_id", "left_semi").join(chosen, ["band", "at"])
            .groupBy("doc_id").agg(F.collect_list(F.struct(F.col("band").alias("unit"), F.col("at").alias("band"))).alias("units")))
    whole = clusters.join(sparse, "cluster", "left_anti").select("doc_id", F.array(F.struct(
        F.col("cluster").alias("unit"), F.lit(-1).alias("band"))).alias("units"))
    return whole.unionByName(many)


def meetings(nodes: DataFrame, threshold: float) -> DataFrame:
    """``nodes`` (doc_id, size, units, ...) once per pair of blocks that must be compared.

    A unit of at most ``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles is one block. A larger one is
    cut by set size into classes such that texts of the threshold's similarity are in one class or
    in neighbouring ones, and each class by a hash into blocks of about those bounds.
    """
    def blocks(texts, shingles):
        return F.greatest(F.ceil(texts / F.lit(float(BLOCK))), F.ceil(shingles / F.lit(float(BLOCK_SHINGLES)))).cast("int")

    unit = ["unit", "band"]
    flat = nodes.select("doc_id", "size", "signature", "shingles", F.inline("units"))
    large = flat.groupBy(unit).agg(blocks(F.count("*"), F.sum("size")).alias("blocks__"))
    cut = F.floor(F.log(F.greatest("size", F.lit(1))) / -math.log(threshold) + 1e-9).cast("int")
    flat = flat.join(broadcast_if_small(large), unit).withColumn(
        "class__", F.when(F.col("blocks__") > 1, cut).otherwise(0)).drop("blocks__")
    sizes = flat.groupBy(*unit, "class__").agg(blocks(F.count("*"), F.sum("size")).alias("n"))
    near = sizes
    for name, step in (("next__", 1), ("prior__", -1)):
        other = sizes.select(*unit, (F.col("class__") - step).alias("class__"), F.col("n").alias(name))
        near = near.join(other, [*unit, "class__"], "left")
    placed = flat.join(broadcast_if_small(near), [*unit, "class__"]).withColumn(
        "at__", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))

    def name(kind, number):
        return kind.cast("long") * (1 << 32) + number.cast("long")

    own = name(F.col("class__"), F.col("at__"))

    def numbers(count):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>"))

    same = F.transform(numbers(F.col("n")), lambda k: F.struct(
        name(F.col("class__"), F.least(k, F.col("at__"))).alias("one"),
        name(F.col("class__"), F.greatest(k, F.col("at__"))).alias("two")))
    after = F.transform(numbers(F.col("next__")), lambda k: F.struct(
        own.alias("one"), name(F.col("class__") + 1, k).alias("two")))
    prior = F.transform(numbers(F.col("prior__")), lambda k: F.struct(
        name(F.col("class__") - 1, k).alias("one"), own.alias("two")))
    return (placed.withColumn("block", own)
            .withColumn("pair__", F.explode(F.concat(same, after, prior)))
            .select(*unit, "pair__.one", "pair__.two", "block", "doc_id", "size", "signature", "shingles"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
         threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, group_id.

    class_id is the smallest id with the same shingle set, n_links the number of other classes it
    is linked to, group_id the smallest id that chains of links and copies reach. A text without
    words is a class of its own without links; a text of fewer words than ``width`` equals only
    texts of the same words. Rows that share an id count as one document. Null ids take no part
    and come back with null class and group. Other columns take no part. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = rows.where("doc_id is not null")
    sketches = stored(named.mapInArrow(
        lambda b: sketch(b, width), "doc_id long, class_key binary, bands array<long>"), "sketches")
    classes = sketches.groupBy("class_key").agg(F.min("doc_id").alias("class_id"),
                                                F.count("*").alias("class_size"))
    members = stored(sketches.select("doc_id", "class_key").join(broadcast_if_small(classes), "class_key")
                     .select("doc_id", "class_id", "class_size"), "members")
    heads = members.where("doc_id = class_id").select("doc_id").distinct()
    banded = sketches.select("doc_id", "bands").join(heads, "doc_id", "left_semi").select(
        "doc_id", F.posexplode("bands").alias("at", "band"))
    buckets = stored(banded.groupBy("band").agg(
        F.min("doc_id").alias("pivot"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("mark"),
        F.min("at").alias("at")).where("n > 1"), "buckets")
    ties = banded.join(buckets.select("band", "pivot"), "band").where("doc_id <> pivot").select(
        F.col("doc_id").alias("u"), F.col("pivot").alias("v"))
    clusters = stored(components(ties).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")),
                      "clusters")
    held = named.join(broadcast_if_small(clusters.select("doc_id")), "doc_id", "left_semi").mapInArrow(
        lambda b: contents(b, width), "doc_id long, size long, signature binary, shingles binary")
    units = units_of(banded, buckets, clusters)
    nodes = stored(held.join(broadcast_if_small(units), "doc_id"), "nodes")
    found = stored(meetings(nodes, threshold)
                   .repartitionByRange(*MEETING)
                   .sortWithinPartitions(*MEETING)
                   .mapInArrow(lambda b: compare(b, threshold, tolerance), "doc_id long, links long, root long"),
                   "links")
    counts = found.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    facts = counts.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        F.col("doc_id").alias("class_id"), "n_links", "root")
    result = members.join(broadcast_if_small(facts), "class_id", "left").select(
        "doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "class_id").alias("group_id"))
    nameless = rows.where("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group_id"))
    return result.unionByName(nameless)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each group, and all rows without an id."""
    dropped = join(docs, doc_id, text).where("doc_id <> group_id").select(F.col("doc_id").alias("doc_id__"))
    return docs.join(dropped, F.col(doc_id).cast("long") == F.col("doc_id__"), "left_anti")
