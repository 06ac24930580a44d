"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

1. Terms of a text: hashed words (long ones in successive pieces) and word shapes (letters collapsed, marks kept), weighted by
   (1 + log count) times the inverse document frequency, which is counted over all documents, and
   scaled to length one. To these come steps of a few shares of its words: repeats of the word
   before, capitals, marks, words without letters, digits.
2. A bounded sample of the labelled documents (``sample`` rows, by a hash of their id, a
   documented parameter) gives a truncated singular value decomposition: the latent space.
3. The sample's latent vectors and labels are broadcast: their size is bounded by ``sample`` times
   ``rank``. Every document is projected and multiplied with all of them, block by block, and its
   ``neighbours`` nearest vote with their cosine as weight. Sampled texts equal to a document's own
   do not vote for it, whatever their ids.

Text, label and hash of the id choose the sample; scores see the text alone, so copies have one score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_TERMS, SHAPE_TERMS = 3072, 1024
TERMS = WORD_TERMS + SHAPE_TERMS
KINDS = ("capitals", "marks", "letterless", "digits")
STEPS = np.array([0.03, 0.1, 0.2, 0.4])
STEP_WEIGHT = 0.4
ADDED_WORDS = 15
SHARES = (len(KINDS) + 1) * len(STEPS)
SAMPLE = 6000
RANK = 48
NEIGHBOURS = 15
MEMO = 300_000
PIECE = 50  # longer words are cut into pieces of so many characters, all of which count
ROWS_AT_ONCE = 256
LOWER, UPPER, DIGITS = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
ENDS = frozenset(".,;:!?'\"()")
MARK = re.compile(r"[^\w.,;:!?'\"()-]|[!?]{2}")


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


@lru_cache(maxsize=10_000)
def shape_term(shape: str) -> int:
    return WORD_TERMS + xxhash.xxh32_intdigest(shape) % SHAPE_TERMS


class TermsOfWords(dict):
    """Word term, shape term and kinds of a word, as one number; remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        core, tail = (word[:-1], word[-1]) if word[-1] in ENDS else (word, "")
        if core.isalpha() and (core.islower() or ("A" <= core[0] <= "Z" and (len(core) == 1 or core[1:].islower()))):
            # most words: letters of one case or capitalised, then at most one mark
            shape = ("a" if core.islower() else "Aa" if len(core) > 1 else "A") + tail
            kinds = (len(core) > 1 and core.upper() == core, False, False, False)
        else:
            shape = UPPER.sub("A", LOWER.sub("a", DIGITS.sub("0", word)))
            letters = sum(map(str.isalpha, word))
            kinds = (letters > 1 and word.upper() == word, bool(MARK.search(word)), not letters, any(map(str.isdigit, word)))
        value = xxhash.xxh32_intdigest(word.lower()) % WORD_TERMS
        value = value * TERMS + shape_term(shape)
        for kind in kinds:
            value = value * 2 + kind
        self[word] = value
        return value


@lru_cache(maxsize=1)
def terms_of_words() -> TermsOfWords:
    return TermsOfWords()


def words_of(text: str) -> list[str]:
    """Words between white space; text without any (Chinese, base64, minified code) in pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [word[at:at + PIECE] for word in words for at in range(0, len(word), PIECE)]


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a text, 1 + log of their counts, and the steps its shares reach."""
    words = words_of(text or "")
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(SHARES, np.float32)
    codes = np.fromiter(map(terms_of_words().__getitem__, words), np.int64, len(words))
    kinds = codes % (1 << len(KINDS))
    # the added words keep one chance repeat in a short text from looking like a habit
    shares = np.array([(codes[1:] == codes[:-1]).sum(), *((kinds >> i & 1).sum() for i in range(len(KINDS)))]
                      ) / (len(codes) + ADDED_WORDS)
    terms = codes >> len(KINDS)
    counts = np.bincount(terms // TERMS, minlength=TERMS) + np.bincount(terms % TERMS, minlength=TERMS)
    found = np.flatnonzero(counts)
    steps = (shares[:, None] >= STEPS).ravel().astype(np.float32)
    return found, (1 + np.log(counts[found])).astype(np.float32), steps


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen[term_counts(value.as_py())[0]] += 1
                rows += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(TERMS + 1), "n": np.append(seen, rows)})

    counted = (docs.select(F.col(text).cast("string")).mapInArrow(run, "term long, n long")
               .groupBy("term").agg(F.sum("n").alias("n")).collect())
    found = np.zeros(TERMS + 1, np.int64)
    for term, n in counted:
        found[term] = n
    return found[:TERMS], int(found[TERMS])


def weights_of(found: np.ndarray, total: int) -> np.ndarray:
    return np.log((1 + total) / (1 + found)).astype(np.float32) + np.float32(0.1)


def rows_of(counted: list[tuple], weights: np.ndarray) -> np.ndarray:
    """Term vectors of length one, followed by the steps; zero for texts without words."""
    rows = np.zeros((len(counted), TERMS + SHARES), np.float32)
    for row, (terms, counts, steps) in zip(rows, counted):
        if len(terms):
            values = counts * weights[terms]
            row[terms] = values / max(float(np.sqrt(values @ values)), 1e-9)
            row[TERMS:] = STEP_WEIGHT * steps
    return rows


def latent_space(rows: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with power steps."""
    rng = np.random.default_rng(seed)
    rank = min(rank, *rows.shape)
    basis = rows.T @ rng.standard_normal((rows.shape[0], min(rank + 16, *rows.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(basis)
        basis = rows.T @ (rows @ basis)
    basis, _ = np.linalg.qr(basis)
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :rank].astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def votes(vectors: np.ndarray, texts: list[str | None], model: dict) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors; the base rate for a
    text that resembles none."""
    labelled, labels, k = model["vectors"], model["labels"], model["neighbours"]
    cosine = vectors @ labelled.T
    own = [(i, at) for i, text in enumerate(texts) for at in model["places"].get(digest(text), ())]
    if own:
        cosine[tuple(zip(*own))] = -1
    k = min(k, len(labels))
    nearest = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
    weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    return np.where(total > 1e-12, (weight * labels[nearest]).sum(axis=1) / np.maximum(total, 1e-12),
                    model["base"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> dict:
    """The model from at most ``sample`` labelled documents that are not held out.

    Null labels are left out; a document with several labels counts with the smallest.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("id__"), F.col(label).cast("int").alias("y__"))
             .where(F.col("id__").isNotNull() & F.col("y__").isNotNull() & ~is_held_out(F.col("id__")))
             .groupBy("id__").agg(F.min("y__").alias("y__"))
             .orderBy(F.xxhash64("id__"), "id__").limit(sample))
    found, total = document_frequencies(docs, text)
    weights = weights_of(found, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text__").to_pylist()
            counted = [term_counts(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "id__": batch.column("id__"), "y__": batch.column("y__"),
                "digest__": pa.array([digest(t) for t in texts], pa.binary()),
                "terms__": pa.array([c[0].astype("<i4").tobytes() for c in counted], pa.binary()),
                "counts__": pa.array([c[1].tobytes() for c in counted], pa.binary()),
                "steps__": pa.array([c[2].tobytes() for c in counted], pa.binary())})

    rows = (docs.select(F.col(doc_id).cast("long").alias("id__"), F.col(text).cast("string").alias("text__"))
            .join(F.broadcast(known), "id__").mapInArrow(run, "id__ long, y__ int, digest__ binary, terms__ binary, counts__ binary, steps__ binary")
            .orderBy("id__", "digest__").limit(sample).collect())
    dense = rows_of([(np.frombuffer(r["terms__"], "<i4"), np.frombuffer(r["counts__"], np.float32),
                      np.frombuffer(r["steps__"], np.float32)) for r in rows], weights)
    y = np.array([r["y__"] for r in rows], np.float64)
    places: dict = {}
    for i, row in enumerate(rows):
        places.setdefault(bytes(row["digest__"]), []).append(i)
    if not len(rows):
        return {"weights": weights, "space": np.zeros((TERMS + SHARES, 1), np.float32), "vectors": np.zeros((1, 1), np.float32),
                "labels": np.ones(1), "base": 1.0, "neighbours": 1, "places": {}}
    space = latent_space(dense, rank)
    return {"weights": weights, "space": space, "vectors": unit(dense @ space), "labels": y,
            "base": float(y.mean()), "neighbours": neighbours, "places": places}


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the share of good neighbours, from 0 to 1; an existing column is replaced.

    Null and empty texts get the base rate of the sample. Without labelled rows every score is 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    schema = kept.limit(0).withColumn(name, F.lit(None).cast("double")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(text).to_pylist()
                rows = rows_of([term_counts(t) for t in texts], model["weights"])
                scores = votes(unit(rows @ model["space"]), texts, model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())],
                                                 [*part.schema.names, name])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with their own columns."""
    scored = score(docs, fit(docs, labels, doc_id, text), text, "quality_score__")
    return scored.where(F.col("quality_score__") >= least).drop("quality_score__")
