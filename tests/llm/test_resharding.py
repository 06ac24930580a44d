"""Flows against the least possible cost, and whole tables resharded."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import resharding
from cohortmill.llm.queries import QUERIES


def cheapest_by_search(sources, sinks, cost):
    """Least cost of moving unit supplies to unit demands, by trying all orders."""
    return min(sum(cost[s][t] for s, t in zip(sources, order)) for order in set(itertools.permutations(sinks)))


def test_network_finds_the_least_cost():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m = rng.integers(1, 4), rng.integers(1, 4)
        cost = rng.integers(0, 6, (n, m))
        supply = rng.multinomial(6, np.ones(n) / n)
        demand = rng.multinomial(6, np.ones(m) / m)
        net = resharding.Network(2 + n + m)
        arcs = {(i, j): net.arc(2 + i, 2 + n + j, 6, int(cost[i, j])) for i in range(n) for j in range(m)}
        for i in range(n):
            net.arc(0, 2 + i, int(supply[i]), 0)
        for j in range(m):
            net.arc(2 + n + j, 1, int(demand[j]), 0)
        net.solve(0, 1)
        flow = {k: net.carried(a) for k, a in arcs.items()}
        assert [sum(flow[i, j] for j in range(m)) for i in range(n)] == list(supply)
        assert [sum(flow[i, j] for i in range(n)) for j in range(m)] == list(demand)
        units = [i for i in range(n) for _ in range(supply[i])], [j for j in range(m) for _ in range(demand[j])]
        assert sum(f * cost[k] for k, f in flow.items()) == cheapest_by_search(*units, cost)


@pytest.mark.parametrize("old,new", [
    ({0: 10, 1: 10, 2: 10}, {0: 8, 1: 8, 2: 8, 3: 8}), ({0: 1000, 1: 1, 5: 0}, {0: 400, 1: 400, 2: 400}),
    ({7: 90, 8: 10}, {0: 50, 1: 60}), ({}, {0: 0}), ({0: 5, 1: 5}, {0: 5, 1: 5}), ({i: i * i for i in range(60)}, {i: 2000 for i in range(40)})])
def test_flow_moves_the_fewest_bytes(old, new):
    flow = resharding.cheapest_flow(old, new)
    out, into = Counter(), Counter()
    for (a, b), n in flow.items():
        out[a] += n
        into[b] += n
    assert dict(out) == {s: n for s, n in old.items() if n}
    assert all(n <= new[s] for s, n in into.items())
    assert sum(n for (a, b), n in flow.items() if a != b) == sum(old.values()) - sum(min(n, new.get(s, 0)) for s, n in old.items())


def test_too_little_room_is_an_error():
    with pytest.raises(ValueError, match="cannot hold"):
        resharding.cheapest_flow({0: 5}, {0: 2, 1: 2})


def test_blocks_are_divided_closely():
    rng = np.random.default_rng(9)
    sizes = np.r_[rng.integers(1, 300, 500), 9000]
    rooms = [9100, 1234, int(sizes.sum()) - 9100 - 1234]
    part = resharding.divide(sizes, np.arange(len(sizes)), rooms)
    assert abs(np.bincount(part, sizes, 3) - rooms).max() <= 10
    # a row larger than every room goes where most is left
    assert resharding.divide(np.array([50]), np.array([0]), [20, 30]).tolist() == [1]


def held(rows, shard, slot, size):
    """Bytes by shard, after checking that slots are gapless."""
    slots, total = defaultdict(list), Counter()
    for r in rows:
        slots[r[shard]].append(r[slot])
        total[r[shard]] += r[size]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


def test_query_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op13_resharding"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    total = held(rows, "shard", "slot", "size")
    assert sorted(total) == list(range(8))
    assert max(total.values()) - min(total.values()) <= max(r.size for r in rows) / 20


@pytest.mark.parametrize("files", [1, 40])
def test_only_what_must_move_is_rewritten(spark, files):
    """Lopsided shards, one holding most rows; null and repeated ids, equal rows, clashing columns."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 700).alias("doc_id"),
        F.repeat(F.lit("x"), (F.col("id") % 37).cast("int")).alias("text"), F.lit(1).alias("_shard"), F.lit("b").alias("_slot"),
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 4).alias("old")).repartition(files)
    size = F.length("text") + 1
    folder, schema = resharding.write_shards(df, F.col("old"), size)
    before = spark.read.parquet(folder).groupBy("_shard").agg(F.sum("_size")).collect()
    total = sum(n for _, n in before)
    rows = resharding.reshard(spark, folder, schema, lambda n: resharding.equal_capacities(n, 3)).collect()
    assert Counter((r.doc_id, r.text, r.old) for r in rows) == Counter(tuple(r) for r in df.select("doc_id", "text", "old").collect())
    sums = held(rows, "_shard", "_slot", "_size")
    assert max(sums.values()) - min(sums.values()) <= 40
    least = total - sum(min(n, total / 3) for s, n in before if s < 3)
    assert abs(sum(r._size for r in rows if r._shard != r.old) - least) <= 150


def test_same_shards_move_nothing_and_shards_can_go(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"))
    folder, schema = resharding.write_shards(df, F.col("doc_id") % 3, F.lit(0))
    for capacities, shards in (({0: 100, 1: 100, 2: 100}, {0, 1, 2}), ({1: 200, 2: 200}, {1, 2}), ({9: 300}, {9})):
        rows = resharding.reshard(spark, folder, schema, capacities).collect()
        assert len(rows) == 300 and {r._shard for r in rows} == shards
        held(rows, "_shard", "_slot", "_size")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder, schema = resharding.write_shards(df, F.lit(0), F.lit(1))
    assert resharding.reshard(spark, folder, schema, lambda n: resharding.equal_capacities(n, 4)).count() == 0
