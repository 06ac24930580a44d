"""Alignment of two tokenizers' cuts of a text, by divide and conquer at shared cuts.

Both tokenizers cut the bytes of one text. Where a token of either ends at the same byte, the text
can be parted without splitting a token. An interval is parted at the shared end nearest to its
middle: the first tokenizer's ends around the middle are looked up among the second's by bisection,
in a window that widens fourfold until one is found, and both halves go the same way. An interval
without a shared end inside is a leaf, and a leaf is a group. All intervals of a batch of texts are
parted together, level by level, with array operations: a stretch without cuts is looked at a
bounded number of times, so work is that of a sort however the cuts lie.

Tokens are linked when their byte ranges overlap. The corpus-wide count of a pair of ids is the
number of documents that hold the pair linked.

Token lists of a text lie in memory whole, with about sixty bytes per byte of text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.bpe import byte_letters
from cohortmill.llm.common import stored

CHARS_AT_ONCE = 400_000
HEAD_PAIRS = 1 << 20
SHIFT = 32


class Tokenizers:
    """A byte-level BPE file and a sentencepiece model, with the bytes of their tokens."""

    def __init__(self, first_path: str, second_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(first_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        # ids are the order of the merges; strings of special tokens are plain text here
        ranks = {bytes(letters[c] for c in name): i for name, i in spec["model"]["vocab"].items() if name not in special}
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=second_path)
        self.first_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.first_bytes[i] = piece
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(name[3:5], 16)]) if self.second.is_byte(i) else name.replace("▁", " ").encode()
                             for i, name in enumerate(names)]
        self.first_length = np.array([len(p) for p in self.first_bytes], np.int64)
        self.second_length = np.array([len(p) for p in self.second_bytes], np.int64)
        most = max(len(self.first_bytes), len(names))
        self.followed_by = {mark: np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"}

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Both id lists of each text; both empty where either does not spell a space and the text."""
        spelt = [f" {t}".encode() if t else b"" for t in texts]
        first = [self.first.encode_ordinary(f" {t}") if t else [] for t in texts]
        second = self.second.encode([t or "" for t in texts], num_threads=1)
        fits = _spell(self.first_bytes, self.first_length, first, spelt) & _spell(
            self.second_bytes, self.second_length, second, spelt)
        return [(a, b) if fit else ([], []) for a, b, fit in zip(first, second, fits.tolist())]


def _spell(pieces: list[bytes], lengths: np.ndarray, ids: list[list[int]], texts: list[bytes]) -> np.ndarray:
    """Whether the pieces of each id list are the bytes of its text."""
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    of_token = lengths[np.fromiter(chain.from_iterable(ids), np.int64, many.sum())]
    total = np.r_[0, np.cumsum(of_token)][np.r_[0, np.cumsum(many)]]
    fits = np.diff(total) == np.fromiter(map(len, texts), np.int64, len(texts))
    if fits.all() and b"".join(map(pieces.__getitem__, chain.from_iterable(ids))) == b"".join(texts):
        return fits
    return np.array([b"".join(map(pieces.__getitem__, i)) == t for i, t in zip(ids, texts)], bool)


@lru_cache(maxsize=2)
def tokenizers(first_path: str, second_path: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    return Tokenizers(first_path, second_path)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every interval a0..a1 of tokens the inner token, nearest to the middle, whose end the
    other side shares, and the other side's token that ends there; -1 where there is none."""
    middle = (a0 + a1 - 2) // 2
    cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
    none = np.iinfo(np.int64).max
    open_, reach = np.arange(len(a0)), 0
    while len(open_):
        centre = middle[open_]
        low, high = np.maximum(centre - reach, a0[open_]), np.minimum(centre + reach, a1[open_] - 2)
        width = high - low + 1
        starts = np.cumsum(width) - width
        token = np.arange(width.sum()) - np.repeat(starts - low, width)
        at = np.searchsorted(ends_b, ends_a[token])
        away = token - np.repeat(centre, width)
        order = np.where(ends_b[at] == ends_a[token], np.abs(away) * 2 + (away > 0), none)
        nearest = np.minimum.reduceat(order, starts)
        hit = nearest < none
        best = nearest[hit]
        chosen = centre[hit] + np.where(best & 1, best >> 1, -(best >> 1))
        cut_a[open_[hit]] = chosen
        cut_b[open_[hit]] = at[starts[hit] + chosen - low[hit]]
        open_ = open_[~hit & ((low > a0[open_]) | (high < a1[open_] - 2))]
        reach = max(1, reach * 4)
    return cut_a, cut_b


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """Rows (a0, a1, b0, b1) of token ranges without a shared end inside, in order. ``intervals``
    are rows of the same form whose outer ends are shared; ends ascend over all of them."""
    leaves, left = [np.empty((0, 4), np.int64)], intervals
    while len(left):
        whole = (left[:, 1] - left[:, 0] == 1) | (left[:, 3] - left[:, 2] == 1)
        leaves.append(left[whole])
        left = left[~whole]
        cut_a, cut_b = shared_cuts(ends_a, ends_b, left[:, 0], left[:, 1])
        leaves.append(left[cut_a < 0])
        left, cut_a, cut_b = (x[cut_a >= 0] for x in (left, cut_a, cut_b))
        left = np.concatenate([np.column_stack([left[:, 0], cut_a + 1, left[:, 2], cut_b + 1]),
                               np.column_stack([cut_a + 1, left[:, 1], cut_b + 1, left[:, 3]])])
    found = np.concatenate(leaves)
    return found[np.argsort(found[:, 0])]


def align_texts(known: Tokenizers, texts: list[str | None]) -> dict[str, pa.Array]:
    """Counts, spelt groups, and linked pairs with their times, for a batch of texts."""
    encoded = known.encode(texts)
    many_a = np.array([len(a) for a, _ in encoded], np.int64)
    many_b = np.array([len(b) for _, b in encoded], np.int64)
    first = np.fromiter(chain.from_iterable(a for a, _ in encoded), np.int64, many_a.sum())
    second = np.fromiter(chain.from_iterable(b for _, b in encoded), np.int64, many_b.sum())
    # both sides of a text have the same bytes, so ends run on over the whole batch
    ends_a, ends_b = np.cumsum(known.first_length[first]), np.cumsum(known.second_length[second])
    stop_a, stop_b = np.cumsum(many_a), np.cumsum(many_b)
    texts_held = np.column_stack([stop_a - many_a, stop_a, stop_b - many_b, stop_b])
    leaves = leaf_groups(ends_a, ends_b, texts_held[many_a > 0])
    a0, a1, b0, b1 = leaves.T
    n_groups = np.searchsorted(a0, stop_a) - np.searchsorted(a0, stop_a - many_a)

    spelt = np.empty(len(first) + len(second), object)
    spelt[np.arange(len(first)) + np.repeat(b0, a1 - a0)] = known.followed_by[","][first]
    spelt[np.arange(len(second)) + np.repeat(a1, b1 - b0)] = known.followed_by[","][second]
    spelt[a1 - 1 + b0] = known.followed_by["|"][first[a1 - 1]]
    spelt[a1 + b1 - 1] = known.followed_by[";"][second[b1 - 1]]
    stop = (stop_a + stop_b).tolist()
    groups = ["".join(spelt[start:end].tolist())[:-1] for start, end in zip([0, *stop], stop)]

    # every stretch between neighbouring ends of either side lies in one token of each: one link
    known_a, known_b = np.zeros(ends_a[-1] + 1 if len(ends_a) else 0, bool), np.zeros(ends_b[-1] + 1 if len(ends_b) else 0, bool)
    known_a[ends_a] = known_b[ends_b] = True
    ends = np.flatnonzero(known_a | known_b)
    link_a, link_b = (np.cumsum(side[ends]) - side[ends] for side in (known_a, known_b))
    of_text = np.repeat(np.arange(len(texts)), many_a)[link_a]
    width = len(known.second_bytes)
    link = np.sort((of_text * len(known.first_bytes) + first[link_a]) * width + second[link_b])
    new = np.flatnonzero(np.r_[True, link[1:] != link[:-1]][:len(link)])
    of_text, pair = np.divmod(link[new], len(known.first_bytes) * width)
    pair = (pair // width << SHIFT) | pair % width
    times = np.diff(np.r_[new, len(link)])
    offsets = pa.array(np.searchsorted(of_text, np.arange(len(texts) + 1)).astype(np.int32))
    return {"n_a": pa.array(many_a), "n_b": pa.array(many_b), "n_groups": pa.array(n_groups.astype(np.int64)),
            "groups": pa.array(groups, pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(pair)),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))}


def align(docs: DataFrame, first_path: str, second_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, pairs, times) of every row of ``docs``.

    ``groups`` spells the groups as ``a1,a2|b1;a3|b2,b3`` with decimal ids; ``pairs`` holds the
    distinct linked pairs, the first id shifted by 32 bits plus the second, ``times`` how often each
    is linked. Token ids are of the text with a space before it. Null and empty texts, and texts
    that either tokenizer does not spell back, have no tokens: zeros, an empty ``groups`` and no
    pairs. Rows that repeat an id, or a whole row, are rows of their own; ``row`` numbers them and
    must be stored before it is used as a key. An empty table gives none; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = tokenizers(first_path, second_path)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ids):
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + CHARS_AT_ONCE)))
                columns = align_texts(known, texts.slice(at, end - at).to_pylist())
                rows = pa.array(np.arange(number, number + end - at))
                yield pa.RecordBatch.from_pydict({"row": rows, "doc_id": ids.slice(at, end - at), **columns})
                number += end - at
                at = end

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents the pair is linked, and whether no pair of its first
    id is in more."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    # at most one row per id of the vocabulary
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("first")).agg(F.max("n").alias("most"))
    return stored(counts.withColumn("first", F.shiftright("pair", SHIFT)).join(F.broadcast(most), "first")
                  .select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")


def frequent_from(counts: DataFrame, head_pairs: int) -> int:
    """The least power of two such that at most ``head_pairs`` pairs are counted as often."""
    held, least = 0, 1 << 62
    for level, pairs in sorted(counts.groupBy(F.length(F.bin("n")).alias("level")).count().collect(), reverse=True):
        held += pairs
        if held > head_pairs:
            break
        least = 1 << (level - 1)
    return least


def link_statistics(aligned: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``aligned`` (stored) with n_links, n_best (links whose pair no pair of its first id exceeds)
    and count_sum (the counts of all links), instead of pairs and times.

    The pairs of the most documents, at most ``head_pairs`` of them, are broadcast, so that no
    frequent pair gathers the links of all documents in one task; links of rarer pairs, if there are
    any more, meet their counts in a shuffle.
    """
    counts = pair_counts(aligned)
    least = frequent_from(counts, head_pairs)
    head, tail = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                         F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    sums = summed(links.join(F.broadcast(head), "pair"))
    if least > 1:
        rare = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(tail, "pair")
        sums = (sums.unionByName(summed(rare)).groupBy("row")
                .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    total = F.aggregate("times", F.lit(0).cast("long"), lambda held, x: held + x)
    return (aligned.withColumn("n_links", total).drop("pairs", "times").join(sums, "row", "left")
            .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}))
