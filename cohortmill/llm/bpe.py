"""Byte-level BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest tokens that fit (speculation). BPE would give the
same cut exactly when no merge reaches over any of the cut's boundaries, and whether one does
depends on the two neighbouring tokens alone. So all adjacent pairs of a batch of words are
checked at once with array operations (verification), and only words with a failing pair are
merged exactly, rank by rank.

Why a pair decides: a token grows along its merge tree, so at any rank the piece at its right end
is an element of its right spine, known with the rank at which it disappears into its parent; the
same holds for the left spine of the next token. A merge of (x, y) reaches over the boundary when
its rank comes before the parent's of x, and not after the parent's of y: of equal merges the
leftmost goes first.

Results are packed little-endian unsigned 32-bit ids, the form training shards are written in.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pre-tokenizer's pattern
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
         .replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
         .replace(r"(?!\S)", r"(?!\P{White_Space})"))
NEVER = np.int64(1) << 40
CACHED_WORDS = 200_000
WORDS_AT_ONCE = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others take the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Token tables and spines of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*names.values(), *self.specials.values()]) + 1
        self.size = size
        self.bytes_of = [b""] * size
        self.special_ids = set(self.specials.values())
        for name, i in names.items():
            self.bytes_of[i] = bytes(letters[c] for c in name)
        self.of_byte = [0] * 256
        for i in names.values():
            if len(self.bytes_of[i]) == 1:
                self.of_byte[self.bytes_of[i][0]] = i
        for name, i in self.specials.items():
            self.bytes_of[i] = name.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        left = np.full(size, -1, np.int64)
        right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = names[a + b]
            self.merges.setdefault((names[a], names[b]), (rank, whole))
            if self.rank[whole] < 0:
                left[whole], right[whole], self.rank[whole] = names[a], names[b], rank
        self.right_spine, self.right_parent = self._spine(right)
        self.left_spine, self.left_parent = self._spine(left)
        pairs = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # only tokens that BPE builds from their own bytes may be proposed
        made = np.flatnonzero(self.rank >= 0)
        own = self.compatible(left[made], right[made], self.rank[made])
        usable = {int(i) for i in made[own]} | {i for i in names.values() if self.rank[i] < 0 and len(self.bytes_of[i]) == 1}
        self.of_bytes = {self.bytes_of[i]: i for i in usable}
        self.longest: dict[bytes, int] = {}
        for token in self.of_bytes:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 1), len(token))
        self.words = regex.compile(WORDS)
        self.special_pattern = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}

    def _spine(self, child: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per depth: the spine element of every token, and the rank at which it disappears."""
        element = np.arange(self.size, dtype=np.int64)
        ends = np.full(self.size, NEVER)
        elements, parents = [], []
        while (element >= 0).any():
            elements.append(element)
            parents.append(ends)
            safe = np.maximum(element, 0)
            ends = self.rank[safe]
            element = np.where(element >= 0, child[safe], -1)
        return elements, parents

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below ``before``) reaches over each boundary a|b."""
        fine = np.ones(len(a), bool)
        for xs, x_ends in zip(self.right_spine, self.right_parent):
            x, x_end = xs[a], x_ends[a]
            if not (x >= 0).any():
                break
            for ys, y_ends in zip(self.left_spine, self.left_parent):
                y, y_end = ys[b], y_ends[b]
                open_ = np.flatnonzero(fine & (x >= 0) & (y >= 0))
                if not len(open_):
                    break
                key = x[open_] * self.size + y[open_]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
                if before is not None:
                    rank = np.where(rank < before[open_], rank, NEVER)
                crossed = (rank < NEVER) & (rank < x_end[open_]) & (rank <= y_end[open_])
                fine[open_[crossed]] = False
        return fine

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        found = self.of_bytes.get(word)
        if found is not None:
            return [found]
        ids, at, size = [], 0, len(word)
        of_bytes, longest = self.of_bytes, self.longest
        while at < size:
            end = min(size, at + longest.get(word[at:at + 2], 1))
            while (found := of_bytes.get(word[at:end])) is None:
                end -= 1
            ids.append(found)
            at = end
        return ids

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE: the lowest rank first, of equal ranks the leftmost."""
        ids = [self.of_byte[b] for b in word]
        size = len(ids)
        following, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(self.merges[pair][0], i, *pair) for i in range(size - 1)
                if (pair := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            following[i] = after = following[j]
            if after < size:
                before[after] = i
                if (pair := (ids[i], ids[after])) in self.merges:
                    heapq.heappush(heap, (self.merges[pair][0], i, *pair))
            if (prior := before[i]) >= 0 and (pair := (ids[prior], ids[i])) in self.merges:
                heapq.heappush(heap, (self.merges[pair][0], prior, *pair))
        return [i for i in ids if i >= 0]

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet: propose, verify all pairs, merge the failures."""
        if len(self.cache) + len(words) > CACHED_WORDS + WORDS_AT_ONCE:
            self.cache.clear()
        words = [w for w in words if w not in self.cache]
        if not words:
            return
        encoded = [w.encode() for w in words]
        proposed = [self.greedy(w) for w in encoded]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(words)), lengths)
        at = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.zeros(len(words), bool)
        failing[word_of[at[~fine[back]]]] = True
        packed, ends = flat.astype("<u4").tobytes(), np.cumsum(lengths) * 4
        start = 0
        for word, raw, end, fails in zip(words, encoded, ends.tolist(), failing.tolist()):
            self.cache[word] = (np.array(self.merged(raw), "<u4").tobytes() if fails
                                else packed[start:end])
            start = end

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Bounded lists of words, and the ids of special tokens between them."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield self.specials[part]
            elif len(part) < WORDS_AT_ONCE:
                yield self.words.findall(part)
            else:
                matches = (m.group() for m in self.words.finditer(part))
                while chunk := list(islice(matches, WORDS_AT_ONCE)):
                    yield chunk

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        done: list[bytes] = []
        waiting: list[list] = []
        held = 0

        def settle():
            nonlocal held
            self.learn({w for row in waiting for piece in row if not isinstance(piece, (int, bytes))
                        for w in piece})
            known = self.cache.__getitem__
            for row in waiting:
                for i, piece in enumerate(row):
                    if isinstance(piece, list):
                        row[i] = b"".join(map(known, piece))
                    elif isinstance(piece, int):
                        row[i] = piece.to_bytes(4, "little")
            held = 0

        for text in texts:
            row: list = []
            waiting.append(row)
            for piece in self.pieces(text):
                row.append(piece)
                held += len(piece) if isinstance(piece, list) else 1
                if held >= WORDS_AT_ONCE:
                    settle()
                    done += [b"".join(r) for r in waiting[:-1]]
                    del waiting[:-1]
        settle()
        return done + [b"".join(r) for r in waiting]

    def decode(self, packed: bytes, skip_special: bool = False) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        if skip_special:
            ids = [i for i in ids if i not in self.special_ids]
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    return Vocabulary(path)


def _with(docs: DataFrame, name: str, kind: str, source: str, arrow_type: pa.DataType, convert) -> DataFrame:
    """``docs`` with one more column that ``convert`` makes of the values of another."""
    kept = docs.drop(name)
    schema = kept.limit(0).withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 2000):
                part = batch.slice(at, 2000)
                values = pa.array(convert(part.column(source).to_pylist()), arrow_type)
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with packed token ids of every whole text; an existing ``ids`` column is replaced.

    Null and empty texts get no tokens. Strings of special tokens in a text become those tokens.
    """
    return _with(docs, ids, "binary", text, pa.binary(),
                 lambda texts: vocabulary(path).encode_all([t or "" for t in texts]))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded",
           skip_special: bool = False) -> DataFrame:
    """``tokens`` with the text of its packed ids; null ids give an empty text, bytes that are not
    UTF-8 the replacement character."""
    return _with(tokens, text, "string", ids, pa.string(),
                 lambda packed: [vocabulary(path).decode(p or b"", skip_special) for p in packed])
