"""Hard negatives by integer inner products of all rows with anchors.

Vectors are scaled to whole numbers, so every score is exact. Scores of a tile of anchors and a tile
of candidates are one matrix product, computed by Strassen's recursion: seven products of half size
instead of eight, on int64 tiles padded with zeros to sizes that can be halved. Integer additions
are exact; they may wrap around on the way, which does not matter as long as the score itself fits.

Each tile leaves a heap of the best rows per anchor, and two heaps merge into one by keeping the
best of both. A first round keeps the best rows of the anchor's own label (positives). A second
round has one heap per anchor and positive, for the best rows of other labels whose score lies in a
window at the positive's score.

Rows and anchors meet in a grid of cells: a cell holds one part of the rows and one part of the
anchors, both of bounded bytes, in a task of its own. Rows move once per part of the anchors (one
part up to some ten thousand anchors), anchors once per part of the rows. The first round has cells
per group of labels only; a label that holds many rows is dealt over several parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm.common import partitions, stored
from cohortmill.session import broadcast_if_small

PART_BYTES = 32 * 1024 * 1024
TILE_ANCHORS = 128
TILE_ROWS = 1024
SMALLEST = 32
ABSENT = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, smallest: int = SMALLEST) -> np.ndarray:
    """The product of two int64 matrices. Halves all sides until one is at most ``smallest``."""
    if min(a.shape[0], a.shape[1], b.shape[1]) <= smallest:
        return a @ b
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    s1 = strassen(a11 + a22, b11 + b22, smallest)
    s2 = strassen(a21 + a22, b11, smallest)
    s3 = strassen(a11, b12 - b22, smallest)
    s4 = strassen(a22, b21 - b11, smallest)
    s5 = strassen(a11 + a12, b22, smallest)
    s6 = strassen(a21 - a11, b11 + b12, smallest)
    s7 = strassen(a12 - a22, b21 + b22, smallest)
    whole = np.empty((2 * p, 2 * r), np.int64)
    whole[:p, :r], whole[:p, r:] = s1 + s4 - s5 + s7, s3 + s5
    whole[p:, :r], whole[p:, r:] = s2 + s4, s1 - s2 + s3 + s6
    return whole[:n, :m]


class Heaps:
    """The ``k`` best (score, id) of each of ``many`` lists; higher scores first, then smaller ids."""

    def __init__(self, many: int, k: int):
        self.k = k
        self.owner = self.score = self.key = np.empty(0, np.int64)
        self.least = np.full(many, ABSENT)

    def merge(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Adds a tile: one row of scores per list, ``ABSENT`` where a row is no member."""
        width = scores.shape[1]
        bound = self.least
        if width > self.k:
            kth = np.partition(scores, width - self.k, axis=1)[:, width - self.k]
            bound = np.maximum(bound, kth)
        owner, at = np.nonzero((scores >= bound[:, None]) & (scores > ABSENT))
        if not len(owner):
            return
        owner = np.concatenate([self.owner, owner])
        score = np.concatenate([self.score, scores[owner[len(self.owner):], at]])
        key = np.concatenate([self.key, keys[at]])
        order = np.lexsort((key, -score, owner))
        owner, score, key = owner[order], score[order], key[order]
        place = np.arange(len(owner))
        first = np.r_[True, owner[1:] != owner[:-1]]
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        keep = rank < self.k
        self.owner, self.score, self.key = owner[keep], score[keep], key[keep]
        full = rank == self.k - 1
        self.least[owner[full]] = score[full]


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, whole) of the rows that take part, ``whole`` being floor(scale * x) of every
    component. See ``mine`` for what takes no part."""
    taken = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    taken = taken.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~broken)
    longest = taken.agg(F.max(F.size("vector"))).first()[0] or 1
    # a hundred times a score must fit a long
    largest = float(int(((1 << 63) / 101 / max(longest, 1)) ** 0.5))
    whole = F.transform("vector", lambda x: F.floor(F.when(F.abs(x * scale) < largest, x * scale).otherwise(0.0)).cast("long"))
    fits = ~F.exists("vector", lambda x: F.abs(x * scale) >= largest)
    padded = F.concat("whole", F.array_repeat(F.lit(0).cast("long"), F.lit(max(longest, 1)) - F.size("whole")))
    return (taken.where(fits).select("vec_id", "label", whole.alias("whole"))
            .withColumn("whole", padded).distinct())


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("whole").combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _tiles(rows: pa.Table, anchors: pa.Table):
    """(slice of anchors, slice of rows, scores) of a cell, tile by tile; ids of rows ascend."""
    left, right = _matrix(anchors), _matrix(rows).T
    for top in range(0, anchors.num_rows, TILE_ANCHORS):
        ours = slice(top, min(top + TILE_ANCHORS, anchors.num_rows))
        for start in range(0, rows.num_rows, TILE_ROWS):
            theirs = slice(start, min(start + TILE_ROWS, rows.num_rows))
            yield ours, theirs, strassen(left[ours], np.ascontiguousarray(right[:, theirs]))


BEST = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def best_positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each anchor's own label in a cell."""
    ids, labels = _column(rows, "vec_id"), _column(rows, "label")
    own, wanted, numbers = _column(anchors, "vec_id"), _column(anchors, "label"), _column(anchors, "anchor")
    out, heaps, open_ = [], None, None
    for ours, theirs, scores in _tiles(rows, anchors):
        if ours != open_:
            out, heaps, open_ = [*out, (open_, heaps)], Heaps(ours.stop - ours.start, k), ours
        member = (labels[theirs] == wanted[ours, None]) & (ids[theirs] != own[ours, None])
        heaps.merge(np.where(member, scores, ABSENT), ids[theirs])
    held = [(numbers[at][h.owner], np.zeros(len(h.owner), np.int32), h.score, h.key)
            for at, h in [*out, (open_, heaps)] if h]
    return pa.table([np.concatenate(c) for c in zip(*held)], schema=BEST) if held else BEST.empty_table()


def best_in_windows(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The ``k`` best rows of other labels in the window of each positive of each anchor in a cell."""
    ids, labels = _column(rows, "vec_id"), _column(rows, "label")
    wanted, numbers = _column(anchors, "label"), _column(anchors, "anchor")
    given = anchors.column("scores").to_pylist()
    most = max(map(len, given), default=0)
    tops = np.full((len(given), most), ABSENT)
    for at, scores in enumerate(given):
        tops[at, :len(scores)] = scores
    out, heaps, open_ = [], [], None
    for ours, theirs, scores in _tiles(rows, anchors):
        if ours != open_:
            out, open_ = [*out, (open_, heaps)], ours
            heaps = [Heaps(ours.stop - ours.start, k) for _ in range(most)]
        other = labels[theirs] != wanted[ours, None]
        hundredfold = scores * high
        for number, heap in enumerate(heaps):
            top = tops[ours, number, None]
            at_least = np.where(top == ABSENT, 0, top) * low
            member = other & (scores <= top) & (hundredfold >= at_least) & (top > ABSENT)
            if member.any():
                heap.merge(np.where(member, scores, ABSENT), ids[theirs])
    held = [(numbers[at][h.owner], np.full(len(h.owner), number, np.int32), h.score, h.key)
            for at, heaps_of in [*out, (open_, heaps)] for number, h in enumerate(heaps_of) if len(h.owner)]
    return pa.table([np.concatenate(c) for c in zip(*held)], schema=BEST) if held else BEST.empty_table()


def _best(found: DataFrame, k: int) -> DataFrame:
    """The cells' heaps merged: ``k`` rows per anchor and positive, ranked from 1."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(rows: DataFrame, anchors: DataFrame, best) -> DataFrame:
    """``best`` of every cell (columns bucket, part, block) where rows and anchors meet."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return BEST.empty_table()
        return best(left.sort_by("vec_id"), right)

    cell = ("bucket", "part", "block")
    return rows.groupBy(*cell).cogroup(anchors.groupBy(*cell)).applyInArrow(
        run, "anchor long, positive int, score long, vec_id long")


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         part_bytes: int = PART_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row
    that ``is_anchor`` (a function of the id column) picks and each of its first ``positives`` other
    rows of the same label, the first ``negatives`` rows of other labels whose score n lies in
    low * p <= high * n <= high * p, p being the positive's score. Higher scores come first, then
    smaller ids.

    Rows with a null id, label, vector or component, or a component that is not finite, take no
    part; nor do vectors with components so large that a hundred scores would not fit a long (in 64
    dimensions, scaled components from 37 million on). Shorter vectors are padded with zeros. Rows
    repeated in id, label and scaled vector count once. Different rows of one id stay apart: each is an
    anchor, positive or negative of its own, but never a positive of its own id. An anchor without
    positives, or a positive without negatives in its window, gives no row; neither does an empty table.
    """
    known = stored(usable(rows, vec_id, vector, F.col("label") if label is None else label, scale), "whole")
    count, width = known.agg(F.count("*"), F.max(F.size("whole"))).first()
    held = max(1, part_bytes // (8 * ((width or 1) + 2)))
    spread = partitions(rows.sparkSession)
    per_part = max(1, min(held, -(-count // spread)))
    anchors = known.where(is_anchor(F.col("vec_id")))
    blocks = max(1, -(-anchors.count() // held))
    numbered = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")

    # first round: labels are dealt to buckets, and buckets of many rows to parts
    bucket = F.pmod(F.xxhash64("label"), F.lit(spread)).cast("int")
    sizes = known.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count("*") / F.lit(per_part)).cast("int").alias("parts"))
    sizes = broadcast_if_small(sizes)
    part = F.pmod(F.xxhash64("vec_id", "whole"), F.col("parts")).cast("int")
    by_label = known.withColumn("bucket", bucket).join(sizes, "bucket").select(
        "bucket", part.alias("part"), "vec_id", "label", "whole")
    theirs = numbered.withColumn("bucket", bucket).join(sizes, "bucket").withColumn("block", block).select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "anchor", "vec_id", "label", "whole")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    found = _meet(by_label.select("*", every_block), theirs, lambda r, a: best_positives(r, a, positives))
    best = _best(found, positives)
    chosen = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("chosen"))
    chosen = stored(numbered.join(chosen, "anchor"), "positives")

    # second round: all rows against all anchors that have positives
    parts = max(1, -(-count // per_part))
    all_rows = known.select(F.lit(0).alias("bucket"), F.pmod(F.xxhash64("vec_id", "whole"), F.lit(parts)).cast("int").alias("part"),
                            "vec_id", "label", "whole", every_block)
    wanted = chosen.select(F.lit(0).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                           block.alias("block"), "anchor", "label", "whole", F.col("chosen.score").alias("scores"))
    found = _meet(all_rows, wanted, lambda r, a: best_in_windows(r, a, negatives, low, high))
    named = chosen.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("chosen").alias("positive", "of")).select(
        "anchor", "positive", "anchor_id", F.col("of.vec_id").alias("positive_id"), F.col("of.score").alias("positive_score"))
    return _best(found, negatives).join(named, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
