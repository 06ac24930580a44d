"""Leading components of wide data without a p x p matrix.

A randomised range finder: l random directions are multiplied by the covariance again and again
until the directions of the largest variance are left. Every product is one pass over blocks of
samples: a task multiplies its block with the p x l basis and back, and adds up p x l sums. The basis
is made orthonormal from its l x l Gram matrix, and the l x l projection of the covariance gives the
variances. Only l x l matrices reach the driver; p x l tables lie in the shared folder, where tasks
read them. l is the number of components and ``oversample`` more.

The k components converge by (variance l + 1 / variance k) per round, their variances by its square; with
l = p (narrow data) the first round is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.session import checkpoint_dir, new_table
from cohortmill.sources.byte_files import file_system

BLOCK_BYTES = 16 * 1024 * 1024
NOTHING = 1e-13  # share of the largest squared length below which a direction is noise


@dataclass(frozen=True)
class Basis:
    """A p x r matrix: the stored columns of a table, in order of position, times a small matrix;
    without a table the small matrix's seed of random directions."""

    path: str | None
    size: int
    turn: np.ndarray
    seed: int = 0

    def load(self) -> np.ndarray:
        if self.path is None:
            return np.random.default_rng(self.seed).standard_normal((self.size, len(self.turn))) @ self.turn
        return read_columns(self.path) @ self.turn


def read_columns(path: str) -> np.ndarray:
    """A stored table of position and numbers as a matrix, read in a task."""
    import pyarrow.dataset as dataset

    system, name = file_system(path)
    table = dataset.dataset(name, filesystem=system, format="parquet").to_table().sort_by("position")
    return np.column_stack([table.column(c).to_numpy() for c in table.column_names if c != "position"])


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Blocks of so many rows go to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, mean: np.ndarray | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        yield batch, x if mean is None else x - mean


def _summed(rows: DataFrame, size: int, columns: int, sums_of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], name: str) -> str:
    """Path of the table (position, c0, c1, ...) of ``sums_of`` every task, added up."""
    names = [f"c{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums_of(batches)
        for at in range(0, size, 4096):
            part = total[at:at + 4096]
            yield pa.RecordBatch.from_pydict({"position": np.arange(at, at + len(part), dtype=np.int32),
                                              **{n: np.ascontiguousarray(part[:, i]) for i, n in enumerate(names)}})

    summed = rows.mapInArrow(run, "position int, " + ", ".join(f"{n} double" for n in names))
    path = new_table(rows.sparkSession, name)
    summed.groupBy("position").agg(*[F.sum(n).alias(n) for n in names]).write.parquet(path)
    return path


def _small(spark: SparkSession, path: str, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """(basis^T Z, Z^T Z) of a stored table Z: sums per task, added up on the driver."""
    names = spark.read.parquet(path).columns[1:]
    shape = (basis.turn.shape[1] + len(names), len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = basis.load(), np.zeros(shape)
        for batch in batches:
            z = np.column_stack([batch.column(n).to_numpy() for n in names])
            total += np.vstack([q[batch.column("position").to_numpy()].T, z.T]) @ z
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel()]})

    total = np.zeros(shape)
    for row in spark.read.parquet(path).mapInArrow(run, "sums array<double>").collect():
        total += np.array(row["sums"]).reshape(shape)
    return total[:shape[0] - len(names)], total[shape[0] - len(names):]


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """The small matrix that makes columns with this Gram matrix orthonormal; noise is left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(values[-1], 0.0) * NOTHING
    return vectors[:, keep] / np.sqrt(values[keep])


def leading_components(vectors: DataFrame, k: int = 5, oversample: int = 20, tolerance: float = 1e-7, most_rounds: int = 200,
                       seed: int = 7, sample: str = "sample_id", vector: str = "features") -> tuple[DataFrame, DataFrame]:
    """(percent of variance per component, scores per sample), as ``components.principal_components``
    gives them, of vectors of any one length.

    A component's largest loading is positive, the first one of ties. Components beyond the rank
    have no variance and scores of zero. Vectors of different lengths are an error; no rows, or no
    variance at all, give shares and scores of zero. Rounds end when the covariance turns no component by
    more than ``tolerance`` of the largest variance; ``most_rounds`` without that is an error.
    """
    spark = vectors.sparkSession
    array = F.col(vector) if dict(vectors.dtypes)[vector].startswith("array") else vector_to_array(vector)
    path = new_table(spark, "vectors")
    vectors.select(F.col(sample).alias("sample"), array.cast("array<double>").alias("x")).write.parquet(path)
    rows = spark.read.parquet(path)
    n, shortest, size = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != size:
        raise ValueError(f"vectors of {shortest} to {size} components")
    if not n or not size:
        return _result(spark, rows, np.zeros(k), 0.0, None, None, k, sample, vectors)
    with rows_per_batch(spark, BLOCK_BYTES // (8 * size)):
        means = _summed(rows, size, 2, lambda b: _moments(b, size), "means")
        squares = spark.read.parquet(means).agg(F.sum("c1"), F.sum(F.col("c0") * F.col("c0") / n)).first()
        total = max(squares[0] - squares[1], 0.0)

        def multiplied(basis: Basis) -> str:
            def sums_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                q, mean, z = basis.load(), read_columns(means)[:, 0] / n, np.zeros((size, basis.turn.shape[1]))
                for _, x in _blocks(batches, size, mean):
                    z += x.T @ (x @ q)
                return z
            return _summed(rows, size, basis.turn.shape[1], sums_of, "products")

        width = min(size, k + oversample)
        basis = Basis(None, size, np.eye(width), seed)
        for _ in range(most_rounds):
            product = multiplied(basis)
            projected, gram = _small(spark, product, basis)
            if basis.path is not None:
                values, turned = np.linalg.eigh((projected + projected.T) / 2)
                values, turned = values[::-1][:k], turned[:, ::-1][:, :k]
                # how far the covariance turns each component; a basis of all directions holds it exactly
                turning = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turned, gram, turned) - values ** 2, 0.0))
                if width == size or turning.max() <= tolerance * values[0]:
                    break
            turn = orthonormal(gram)
            if not turn.shape[1]:
                return _result(spark, rows, np.zeros(k), 0.0, None, None, k, sample, vectors)
            scale = np.linalg.norm(turn, axis=0)
            if scale.max() > 1e3 * scale.min():  # lengths far apart: once more, from columns of like length
                turn = turn @ orthonormal(_gram(spark, Basis(product, size, turn)))
            basis = Basis(product, size, turn)
        else:
            raise ValueError(f"components still turn after {most_rounds} rounds; raise oversample or tolerance")
        return _result(spark, rows, values, total, Basis(basis.path, size, basis.turn @ turned), means, k, sample, vectors, n)


def _moments(batches: Iterator[pa.RecordBatch], size: int) -> np.ndarray:
    total = np.zeros((size, 2))
    for _, x in _blocks(batches, size, None):
        total[:, 0] += x.sum(axis=0)
        total[:, 1] += (x * x).sum(axis=0)
    return total


def _gram(spark: SparkSession, basis: Basis) -> np.ndarray:
    """Gram matrix of a basis, from its own columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = basis.turn.shape[1]
        total = np.zeros((width, width))
        for batch in batches:
            q = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)]) @ basis.turn
            total += q.T @ q
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel()]})

    found = spark.read.parquet(basis.path).mapInArrow(run, "sums array<double>").collect()
    return sum(np.array(r["sums"]) for r in found).reshape(basis.turn.shape[1], -1)


def _signs(spark: SparkSession, basis: Basis) -> np.ndarray:
    """1 or -1 per column, so that its largest loading is positive: per task the best, then the best of those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.column_stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)]) @ basis.turn
            position = batch.column("position").to_numpy()
            # rounded, so that loadings equal but for the last digits count as ties
            size = np.round(np.abs(v), 9)
            for column in range(v.shape[1]):
                at = np.lexsort((position, -size[:, column]))[0]
                yield pa.RecordBatch.from_pydict({"column": [column], "size": [size[at, column]], "position": [int(position[at])],
                                                  "sign": [1.0 if v[at, column] >= 0 else -1.0]})

    best = spark.read.parquet(basis.path).mapInArrow(run, "column long, size double, position long, sign double").groupBy(
        "column").agg(F.min_by("sign", F.struct(-F.col("size"), "position")).alias("sign")).collect()
    return np.array([r["sign"] for r in sorted(best)])


def _result(spark: SparkSession, rows: DataFrame, values: np.ndarray, total: float, basis: Basis | None, means: str | None,
            k: int, sample: str, vectors: DataFrame, n: int = 0) -> tuple[DataFrame, DataFrame]:
    shares = [100.0 * max(float(v), 0.0) / total if total > 0 else 0.0 for v in values] + [0.0] * (k - len(values))
    variance = spark.createDataFrame([(i + 1, s, float(sum(shares[:i + 1]))) for i, s in enumerate(shares)],
                                     "pc int, var_pct double, cum_pct double")
    kind = dict(vectors.dtypes)[sample]
    schema = f"sample {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(k))
    size = basis.size if basis else 0
    turned = Basis(basis.path, size, basis.turn * _signs(spark, basis)) if basis else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if turned is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("sample"), *[pa.array(np.zeros(batch.num_rows))] * k],
                                                 ["sample", *[f"pc{i + 1}" for i in range(k)]])
            return
        v, mean = turned.load(), read_columns(means)[:, 0] / n
        for batch, x in _blocks(batches, size, mean):
            scores = np.zeros((len(x), k))
            scores[:, :v.shape[1]] = x @ v
            yield pa.RecordBatch.from_arrays([batch.column("sample"), *[pa.array(np.ascontiguousarray(s)) for s in scores.T]],
                                             ["sample", *[f"pc{i + 1}" for i in range(k)]])

    path = new_table(spark, "scores")
    rows.mapInArrow(run, schema).write.parquet(path)
    return variance, spark.read.parquet(path).withColumnRenamed("sample", sample)
