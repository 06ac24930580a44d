"""Mined rows against plain loops and SQL; products against plain products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import hard_negatives
from cohortmill.llm.queries import ORACLES, QUERIES
from tests.compare import check, duck


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (33, 7, 70), (128, 64, 513), (65, 65, 65)])
def test_products_are_exact(shape):
    rng = np.random.default_rng(5)
    n, k, m = shape
    # big enough to wrap around in the additions on the way
    a, b = rng.integers(-1 << 28, 1 << 28, (n, k)), rng.integers(-1 << 28, 1 << 28, (k, m))
    assert (hard_negatives.strassen(a, b, 2) == a @ b).all()


def test_heaps_merge_to_the_best_of_all():
    rng = np.random.default_rng(6)
    scores = rng.integers(0, 12, (7, 90))
    scores[rng.random(scores.shape) < 0.3] = hard_negatives.ABSENT
    scores[3] = hard_negatives.ABSENT
    keys = rng.permutation(90)
    heaps = hard_negatives.Heaps(7, 5)
    for at in (slice(0, 3), slice(3, 50), slice(50, 90)):
        heaps.merge(scores[:, at], keys[at])
    for row in range(7):
        want = sorted((-s, k) for s, k in zip(scores[row], keys) if s > hard_negatives.ABSENT)[:5]
        mine = heaps.owner == row
        assert [(-s, k) for s, k in zip(heaps.score[mine], heaps.key[mine])] == want


def plain(rows, is_anchor, k=5):
    taken = set()
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if any(abs(x) > 1e6 for x in vector):
            continue
        taken.add((i, label, tuple(math.floor(256 * x) for x in vector)))
    width = max((len(v) for _, _, v in taken), default=0)
    taken = {(i, label, v + (0,) * (width - len(v))) for i, label, v in taken}
    out = []
    for i, label, v in taken:
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in taken]
        for p, positive in [(-s, j) for s, j, other in sorted(scored) if other == label and j != i][:k]:
            window = [(j, -s) for s, j, other in sorted(scored, key=lambda r: r[:2])
                      if other != label and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(i, positive, rank, j, p, n) for rank, (j, n) in enumerate(window, 1)]
    return sorted(out)


def odd_rows():
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 6) / 64]) for i in range(300)]
    # ties, copies of an anchor, a label that holds most rows, a label of one row, lengths
    rows += [(i, 1, [0.05] * 6) for i in range(1000, 1400)]
    rows += [(20, 1, [0.05] * 6), (20, 2, [0.05] * 6), (40, 1, [0.1, 0.2]), (60, 7, [0.05] * 6), (80, 2, [])]
    rows += rows[:50] + [rows[20]] * 30
    nan, inf = float("nan"), float("inf")
    return rows + [(None, 1, [0.1]), (100, None, [0.1]), (120, 1, None), (140, 1, [None, 0.1]), (160, 1, [nan]),
                   (180, 1, [inf]), (200, 2, [1e30, 0.0])]


@pytest.mark.parametrize("part_bytes", [1, 5000, hard_negatives.PART_BYTES])
def test_odd_rows_and_any_grid(spark, part_bytes):
    """Nulls, broken and huge components, odd lengths, repeated ids and rows, ties and negative
    scores; the same rows however rows and anchors are dealt over cells."""
    rows = odd_rows()
    if part_bytes == 1:  # a cell per row and anchor
        rows = rows[:24] + rows[-10:]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, label int, embedding array<double>, anchor string, part int")
    got = hard_negatives.mine(df, lambda i: i % 20 == 0, part_bytes=part_bytes)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 20 == 0)


def test_empty_table_and_no_anchors(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(1, 1, [0.5]), (2, 1, [0.25])]):
        assert hard_negatives.mine(spark.createDataFrame(rows, kind), lambda i: i % 20 == 0).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    text, _, good = check(spark, duck(sf_dir), sf_dir, "op12", QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"])
    assert good and "ok 0" not in text, text
