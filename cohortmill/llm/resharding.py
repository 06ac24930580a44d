"""Resharding at minimum cost: which bytes of which shard go where is a minimum-cost flow.

A sharded table is a set of Parquet files; every file (a *block*) belongs to one shard. Old shards
supply their bytes, new shards take bytes up to their capacity, a byte that stays costs nothing and
a byte that moves costs one. The flow of least cost therefore moves the fewest bytes. The network
has an arc from every shard to itself and one hub for all that moves, so its size is that of the
list of shards; it is solved by successive cheapest levels, each filled by a blocking flow.

The flow gives every old shard a list of byte amounts, the bytes that stay first. Its blocks are
laid end to end, those of large rows first, and cut at these amounts. A block inside one amount
goes there whole. A block across a cut is divided by rows: the largest rows first, each into the
first part that still has room, so that a part is short by less than the smallest row that did not
fit. Only blocks that move or are cut are rewritten; all others stay as they lie.

A table that has no shards yet is first written as shards in one pass without a shuffle, each task
one file per shard. Shards and files are listed on the driver, as Spark's own file index is; rows
are not.
"""

from __future__ import annotations

import heapq
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from cohortmill.llm.common import new_folder
from cohortmill.session import broadcast_if_small

SHARD, SLOT, SIZE, PATH, PLACE, ROUND = "_shard", "_slot", "_size", "_path", "_place", "_round"


class Network:
    """Arcs with capacities and costs, and the flow of least cost through them."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, start: int, end: int, room: int, cost: int) -> int:
        """The number of the new arc; the next number is its reverse."""
        for at, target, free, price in ((start, end, room, cost), (end, start, 0, -cost)):
            self.arcs[at].append(len(self.to))
            self.to.append(target)
            self.room.append(free)
            self.cost.append(price)
        return len(self.to) - 2

    def carried(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def _distances(self, source: int, potential: list[int]) -> list[float]:
        """Cheapest reduced cost from the source to every node (no arc with room has a negative one)."""
        distance = [float("inf")] * len(self.arcs)
        distance[source], waiting = 0, [(0, source)]
        while waiting:
            far, at = heapq.heappop(waiting)
            if far > distance[at]:
                continue
            for arc in self.arcs[at]:
                end = self.to[arc]
                if self.room[arc] and (new := far + self.cost[arc] + potential[at] - potential[end]) < distance[end]:
                    distance[end] = new
                    heapq.heappush(waiting, (new, end))
        return distance

    def _fill(self, source: int, sink: int, potential: list[int]) -> None:
        """A largest flow through arcs of reduced cost zero, by blocking flows of growing length."""
        while True:
            depth = {source: 0}
            waiting = deque([source])
            while waiting:
                at = waiting.popleft()
                for arc in self.arcs[at]:
                    end = self.to[arc]
                    if self.room[arc] and end not in depth and self.cost[arc] + potential[at] == potential[end]:
                        depth[end] = depth[at] + 1
                        waiting.append(end)
            if sink not in depth:
                return
            next_arc, path, at = [0] * len(self.arcs), [], source
            while True:
                if at == sink:
                    least = min(self.room[a] for a in path)
                    for a in path:
                        self.room[a] -= least
                        self.room[a ^ 1] += least
                    cut = next(i for i, a in enumerate(path) if not self.room[a])
                    at = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                for number in range(next_arc[at], len(self.arcs[at])):
                    arc, next_arc[at] = self.arcs[at][number], number
                    end = self.to[arc]
                    if (self.room[arc] and depth.get(end) == depth[at] + 1
                            and self.cost[arc] + potential[at] == potential[end]):
                        path.append(arc)
                        at = end
                        break
                else:
                    if not path:
                        break
                    next_arc[at] = len(self.arcs[at])
                    at = self.to[path.pop() ^ 1]
                    next_arc[at] += 1

    def solve(self, source: int, sink: int) -> None:
        """Costs must not be negative. Each round fills all paths of one cost, the cheapest first."""
        potential = [0] * len(self.arcs)
        while True:
            distance = self._distances(source, potential)
            if distance[sink] == float("inf"):
                return
            potential = [p + int(min(d, distance[sink])) for p, d in zip(potential, distance)]
            self._fill(source, sink, potential)


def cheapest_flow(sizes: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes by (old shard, new shard) that move the fewest bytes, all of them placed.

    Capacities must hold the total. Shards absent from ``capacities`` are emptied.
    """
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError(f"capacities of {sum(capacities.values())} bytes cannot hold {sum(sizes.values())}")
    old, new = sorted(sizes), sorted(capacities)
    source, sink, hub = 0, 1, 2
    leaving = {s: 3 + i for i, s in enumerate(old)}
    entering = {s: 3 + len(old) + i for i, s in enumerate(new)}
    network = Network(3 + len(old) + len(new))
    stay, out, into = {}, {}, {}
    for shard in old:
        network.arc(source, leaving[shard], sizes[shard], 0)
        if shard in entering:
            stay[shard] = network.arc(leaving[shard], entering[shard], sizes[shard], 0)
        out[shard] = network.arc(leaving[shard], hub, sizes[shard], 1)
    for shard in new:
        into[shard] = network.arc(hub, entering[shard], capacities[shard], 0)
        network.arc(entering[shard], sink, capacities[shard], 0)
    network.solve(source, sink)
    flow = {(s, s): network.carried(arc) for s, arc in stay.items()}
    # what passes the hub is handed on in the order of the shards
    wanted = deque((s, n) for s, arc in into.items() if (n := network.carried(arc)))
    for shard, arc in out.items():
        left = network.carried(arc)
        while left:
            target, n = wanted.popleft()
            taken = min(left, n)
            flow[shard, target] = flow.get((shard, target), 0) + taken
            left -= taken
            if n > taken:
                wanted.appendleft((target, n - taken))
    return {k: n for k, n in flow.items() if n}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    """The total in near equal parts, larger ones first."""
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def write_shards(rows: DataFrame, shard: Column, size: Column) -> tuple[str, StructType]:
    """Writes the rows as a sharded table; its folder and the schema of the rows. Without a shuffle:
    every task writes one file per shard that it meets, so blocks are bounded by the input's splits.

    A row counts at least one byte. Input columns called _shard, _size, _path, _place or _slot are
    left out.
    """
    folder = new_folder(rows.sparkSession, "shards")
    marked = rows.withColumns({"_to": shard.cast("int"), "_bytes": F.greatest(size.cast("long"), F.lit(1))})
    plain = marked.drop(SHARD, SIZE, PATH, PLACE, SLOT)
    marked = plain.withColumnsRenamed({"_to": SHARD, "_bytes": SIZE})
    marked.write.partitionBy(SHARD).option("compression", "zstd").parquet(folder)
    return folder, plain.drop("_to", "_bytes").schema


def _read(spark: SparkSession, folder: str, schema: StructType, paths: list[str] | None = None) -> DataFrame:
    """Rows of a sharded table, with the file (path below the folder) and place of each."""
    reader = spark.read.schema(StructType([*schema.fields]).add(SIZE, LongType()).add(SHARD, IntegerType()))
    paths = [folder] if paths is None else [f"{folder}/{path}" for path in paths]
    path = F.regexp_extract("_metadata.file_path", f"({SHARD}=[^/]*/[^/]*)$", 1)
    return reader.option("basePath", folder).parquet(*paths).withColumns({PATH: path, PLACE: F.col("_metadata.row_index")})


def blocks(rows: DataFrame) -> list[tuple[int, str, int, int, int]]:
    """(shard, path, bytes, rows, largest row) of every file of a sharded table."""
    found = rows.groupBy(SHARD, PATH).agg(F.sum(SIZE), F.count("*"), F.max(SIZE)).collect()
    return [tuple(r) for r in found]


def lay_out(held: list[tuple[int, str, int, int, int]], flow: dict[tuple[int, int], int]
            ) -> tuple[dict[str, int], dict[str, list[tuple[int, int]]]]:
    """The new shard of every block that goes whole, and the parts (new shard, bytes) of every
    block that is cut."""
    whole, cut = {}, {}
    amounts: dict[int, list[list[int]]] = {}
    for (old, new), n in sorted(flow.items(), key=lambda f: (f[0][0], f[0][0] != f[0][1], f[0][1])):
        amounts.setdefault(old, []).append([new, n])
    # blocks of large rows first: cuts then fall into blocks of small rows
    for shard, path, size, _, _ in sorted(held, key=lambda b: (b[0], -b[4], b[1])):
        parts, left = [], size
        while left:
            first = amounts[shard][0]
            taken = min(left, first[1])
            parts.append((first[0], taken))
            first[1] -= taken
            left -= taken
            if not first[1]:
                amounts[shard].pop(0)
        if len(parts) == 1:
            whole[path] = parts[0][0]
        else:
            cut[path] = parts
    return whole, cut


def divide(sizes: np.ndarray, places: np.ndarray, rooms: list[int]) -> np.ndarray:
    """The part of every row: largest rows first, each into the first part that still holds it, and
    into the one with the most room if none does."""
    part = np.empty(len(sizes), np.int64)
    room = np.array(rooms, np.int64)
    for at in np.lexsort((places, -sizes)):
        fits = np.flatnonzero(room >= sizes[at])
        part[at] = fits[0] if len(fits) else int(np.argmax(room))
        room[part[at]] -= sizes[at]
    return part


def reshard(spark: SparkSession, folder: str, schema: StructType, capacities) -> DataFrame:
    """The rows of a sharded table in their new shards: the columns of ``schema`` and ``_shard``,
    ``_slot`` (from 0 in every shard, gapless), ``_size``.

    ``capacities`` gives bytes by shard, or is a function of the total that does. Rows are read from
    the blocks that stay and from the rewritten ones; slots follow the blocks, those that stay
    first, and the places in them. Equal rows, equal sizes and null columns are rows like any other.
    An empty table stays empty. A row larger than a capacity goes where most room is left.
    """
    old = _read(spark, folder, schema)
    held = blocks(old)
    sizes: dict[int, int] = {}
    for shard, _, size, _, _ in held:
        sizes[shard] = sizes.get(shard, 0) + size
    rooms = capacities(sum(sizes.values())) if callable(capacities) else capacities
    whole, cut = lay_out(held, cheapest_flow(sizes, rooms))
    staying = [path for shard, path, *_ in held if whole.get(path) == shard]
    moving = [(path, whole[path]) for shard, path, *_ in held if path in whole and whole[path] != shard]
    rewritten = []
    if moving:
        # one row per file that goes whole
        targets = broadcast_if_small(spark.createDataFrame(moving, f"{PATH} string, _to int"))
        rewritten.append(_read(spark, folder, schema, [path for path, _ in moving]).join(targets, PATH))
    if cut:
        rows = _read(spark, folder, schema, list(cut))
        # one row per row of the files that are cut, at most one file per amount of the flow
        rewritten.append(rows.join(broadcast_if_small(_parts(rows, cut)), [PATH, PLACE]))
    found = [_read(spark, folder, schema, staying).withColumn(ROUND, F.lit(0))] if staying else []
    if rewritten:
        again = new_folder(spark, "shards")
        (reduce(DataFrame.unionByName, rewritten).drop(PATH, PLACE, SHARD).withColumnRenamed("_to", SHARD)
         .write.partitionBy(SHARD).option("compression", "zstd").parquet(again))
        found.append(_read(spark, again, schema).withColumn(ROUND, F.lit(1)))
    return _numbered(reduce(DataFrame.unionByName, found or [old.withColumn(ROUND, F.lit(0))]))


def _parts(rows: DataFrame, cut: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """(path, place, new shard) of the rows of blocks that are cut, one block at a time."""
    def run(block: pa.Table) -> pa.Table:
        parts = cut[block.column(PATH)[0].as_py()]
        shards = np.array([shard for shard, _ in parts], np.int32)
        places = block.column(PLACE).to_numpy()
        part = divide(block.column(SIZE).to_numpy(), places, [n for _, n in parts])
        return pa.table({PATH: block.column(PATH), PLACE: places, "_to": shards[part]})

    return rows.select(PATH, PLACE, SIZE).groupBy(PATH).applyInArrow(run, f"{PATH} string, {PLACE} long, _to int")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their slot: the rows of earlier blocks of the shard, and the place in the block."""
    counts = rows.groupBy(SHARD, ROUND, PATH).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(SHARD).orderBy(ROUND, PATH).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long"))).drop("_rows")
    # one row per file of the table
    return (rows.join(broadcast_if_small(starts), [SHARD, ROUND, PATH])
            .withColumn(SLOT, F.col("_start") + F.col(PLACE)).drop("_start", ROUND, PATH, PLACE))
