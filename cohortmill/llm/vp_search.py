"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Inner products become distances by one more coordinate: every row gets sqrt(M^2 - |x|^2), where M
is the largest norm, and a query, scaled to length M, gets 0. Then the squared distance is
2 M^2 - 2 M <q, x> / |q|, so the nearest rows are those with the largest inner product, and the
triangle inequality holds.

A node of a tree splits its rows at the median distance to a vantage point and keeps the range of
distances on either side. A query at distance d from the vantage point can skip a side whose range
[lo, hi] is further away than its current k-th neighbour: max(lo - d, d - hi) > tau. ``factor``
relaxes this to ``factor * max(...) > tau``: one is exact, more prunes more and may miss rows.

Rows are dealt to shards of bounded size by a hash; each shard's tree is one index row.
Queries are packed into bounded blocks; every block meets every shard in a task of its own, all
queries of the block walk the tree together as arrays, and each returns its k best. Scores of the
rows returned are summed again in coordinate order in double precision, so equal vectors tie.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm.common import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
LEAF_ROWS = 128


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of rows that take part: an id, and a vector of the commonest
    length without null or non-finite components that is not zero. Repeated rows count once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(vector).cast("array<double>").alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~broken
                      & F.exists("vector", lambda x: x != 0)).distinct()
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common[0] if common else 0))


def tree(ids: np.ndarray, rows: np.ndarray, longest: float, copies: int) -> dict:
    """A vantage-point tree of distinct (id, vector) rows. Of equal vectors only the ``copies``
    smallest ids are kept: with ties going to smaller ids the others can never be among the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order] + 0.0  # minus zero equals zero
    _, kind = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    first = np.r_[True, kind[by_kind][1:] != kind[by_kind][:-1]]
    number = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    keep = np.sort(by_kind[number < copies])
    ids, rows = ids[keep], rows[keep]
    squares = (rows * rows).sum(axis=1)
    extra = np.sqrt(np.maximum(longest ** 2 - squares, 0.0))
    place = np.arange(len(ids))
    nodes: list[tuple] = []

    def build(lo: int, hi: int, pivot: int) -> int:
        at = len(nodes)
        nodes.append(())
        if hi - lo <= LEAF_ROWS:
            nodes[at] = (lo, hi)
            return at
        mine = place[lo:hi]
        # the row furthest from the parent's vantage point sees the others spread widest
        vantage = int(mine[np.argmax(((rows[mine] - rows[pivot]) ** 2).sum(axis=1))])
        distance = np.sqrt(((rows[mine] - rows[vantage]) ** 2).sum(axis=1) + (extra[mine] - extra[vantage]) ** 2)
        ranked = np.argsort(distance, kind="stable")
        place[lo:hi], distance = mine[ranked], distance[ranked]
        half = (hi - lo) // 2
        near = build(lo, lo + half, vantage)
        far = build(lo + half, hi, vantage)
        nodes[at] = (vantage, near, far, distance[0], distance[half - 1], distance[half], distance[-1])
        return at

    if len(ids):
        build(0, len(ids), 0)
    return {"ids": ids, "rows": rows, "extra": extra, "place": place, "nodes": nodes, "longest": longest}


def nearest(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query position, row position, score) of the k best rows of the tree for every query, and
    the share of query-row products that were computed."""
    ids, rows, nodes, place = index["ids"], index["rows"], index["nodes"], index["place"]
    many = len(queries)
    squares = (queries * queries).sum(axis=1)
    reach = 2 * index["longest"] ** 2
    scale = index["longest"] / np.sqrt(np.maximum(squares, 1e-300))
    slack = 1e-12 * np.sqrt(squares) * index["longest"]
    best = np.full((many, k), -np.inf)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    visited = np.full(many, -1)
    work = 0

    def look(active: np.ndarray, node: int) -> None:
        nonlocal work
        lo, hi = nodes[node]
        mine = place[lo:hi]
        work += len(active) * len(mine)
        score = queries[active] @ rows[mine].T
        score[query_ids[active][:, None] == ids[mine][None, :]] = -np.inf
        both = np.concatenate([best[active], score], axis=1)
        best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        q, r = np.nonzero(score >= np.maximum(best[active].min(axis=1) - slack[active], -1e300)[:, None])
        hits.append((active[q], mine[r], score[q, r]))

    def away(active: np.ndarray, vantage: int) -> np.ndarray:
        square = reach - 2 * scale[active] * (queries[active] @ rows[vantage])
        return np.sqrt(np.maximum(square, 0.0))

    def descend(active: np.ndarray, node: int) -> None:
        if len(nodes[node]) == 2:
            visited[active] = node
            look(active, node)
            return
        vantage, near, far, _, near_hi, far_lo, _ = nodes[node]
        inside = away(active, vantage) <= (near_hi + far_lo) / 2
        for part, child in ((active[inside], near), (active[~inside], far)):
            if len(part):
                descend(part, child)

    def walk(active: np.ndarray, node: int) -> None:
        if len(nodes[node]) == 2:
            active = active[visited[active] != node]
            if len(active):
                look(active, node)
            return
        vantage, near, far, near_lo, near_hi, far_lo, far_hi = nodes[node]
        distance = away(active, vantage)
        for child, lo, hi in ((near, near_lo, near_hi), (far, far_lo, far_hi)):
            worst = best[active].min(axis=1)
            known = np.isfinite(worst)
            tau = np.sqrt(np.maximum(reach - 2 * scale[active] * np.where(known, worst, 0.0), 0.0))
            tau = np.where(known, tau, np.inf)
            gap = np.maximum(np.maximum(lo - distance, distance - hi), 0.0)
            # the slack covers rounding of distances, so that factor one stays exact
            open_ = active[factor * gap <= tau + 1e-7 * (index["longest"] + tau)]
            if len(open_):
                walk(open_, child)

    if len(ids) and many:
        everyone = np.arange(many)
        descend(everyone, 0)
        walk(everyone, 0)
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0.0
    q, r, score = (np.concatenate(c) for c in zip(*hits))
    keep = score >= best.min(axis=1)[q] - slack[q]
    q, r = q[keep], r[keep]
    exact = np.zeros(len(q))
    for j in range(rows.shape[1]):
        exact += queries[q, j] * rows[r, j]
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    starts = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(starts, np.arange(len(q)), 0))
    top = rank < k
    return q[top], r[top], exact[top], work / (many * len(ids))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, tree) of every usable row; a shard holds about ``shard_rows`` rows."""
    count, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda total, x: total + x * x)))).first()
    shards = max(1, -(-count // shard_rows))
    longest = float(longest or 0.0)

    def build(shard: pa.Table) -> pa.Table:
        made = tree(shard.column("vec_id").to_numpy(), _matrix(shard.column("vector")), longest, k + 1)
        return pa.table({"shard": shard.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(made)], pa.binary())})

    return stored(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
                  .groupBy("shard").applyInArrow(build, "shard int, tree binary"), "index")


def search(index: DataFrame, queries: DataFrame, k: int, factor: float,
           block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each row of queries (vec_id, vector),
    without rows of the query's own id. Work and data moved are blocks of queries times shards."""
    numbered = stored(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-numbered.count() // block_queries))
    shards = index.agg(F.max("shard")).first()[0]

    def pack(block: pa.Table) -> pa.Table:
        packed = pickle.dumps((block.column("query").to_numpy(), block.column("vec_id").to_numpy(), _matrix(block.column("vector"))))
        return pa.table({"block": block.column("block").slice(0, 1), "queries": pa.array([packed], pa.binary())})

    packed = (numbered.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
              .groupBy("block").applyInArrow(pack, "block int, queries binary"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards if shards is not None else 0))))
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for made in trees.column("tree").to_pylist():
            made = pickle.loads(made)
            for block in blocks.column("queries").to_pylist():
                numbers, ids, vectors = pickle.loads(block)
                q, r, score, _ = nearest(made, ids, vectors, k, factor)
                out.append(pa.table([numbers[q], ids[q], made["ids"][r], score], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        meet, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def neighbours(vectors: DataFrame, is_query, k: int = 20, factor: float = 1.0, vec_id: str = "vec_id",
               vector: str = "embedding") -> DataFrame:
    """The k nearest rows of every row that ``is_query`` (a function of the id column) picks.

    Null, zero, broken or odd-length vectors and null ids take no part. Ties go to the smaller id.
    Rows repeated in id and vector count once. Different vectors of one id are candidates of their
    own, and queries of their own with k ranks each; rows of a query's own id are not its candidates.
    A query with fewer candidates than k gets all of them; an empty table gives an empty result.
    """
    rows = stored(usable(vectors, vec_id, vector), "vectors")
    return search(build_index(rows, k), rows.where(is_query(F.col("vec_id"))), k, factor)
