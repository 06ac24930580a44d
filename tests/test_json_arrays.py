"""JSON arrays cut at any byte give the elements of the whole."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortmill.plans.source_queries import _array_files
from cohortmill.sources import byte_files
from cohortmill.sources import json_arrays as J
from cohortmill.sources import nested as N

TRICKY = ['"', "\\", "\\\\", '\\"', "[", "]", "{", "}", ",", ":", '"]', '",{', "é", "漢", "\n", "\t", "", "data", "hits"]


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return "".join(rng.choices(TRICKY, k=rng.randint(0, 6)))
    if kind < 0.55:
        return rng.choice([None, True, False, 0, -1.5e3, 12345678901])
    if kind < 0.8:
        return {"".join(rng.choices(TRICKY, k=rng.randint(0, 3))): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b'"', b"\\", b"\\\\", b"a", b"[", b",", b"{"]), max_size=30).map(b"".join), st.booleans())
def test_escapes_across_a_cut(data, escaped):
    want, slash = [], escaped
    for at, byte in enumerate(data):
        if byte == J.QUOTE and not slash:
            want.append(at)
        slash = byte == J.BACKSLASH and not slash
    quotes, after = J.unescaped_quotes(np.frombuffer(data, np.uint8), escaped)
    assert quotes.tolist() == want and after == slash


def cut_up(path, size, keys, width, chunk):
    """All three passes over ranges of ``width`` bytes, without Spark."""
    ranges = [(s, min(s + width, size)) for s in range(0, size, width)]
    state, depth, starts = J.OUTSIDE, 0, []
    for start, stop in ranges:
        starts.append((start, stop, state, depth))
        ends = J.sum_up(path, start, stop, chunk)
        state, depth = ends[state][0], depth + ends[state][1]
    assert (state, depth) == (J.OUTSIDE, 0)
    level = len(keys) + 1
    spans = J.array_spans([e for r in starts for e in J.outline_of(path, *r, level, chunk)], keys)
    found = []
    for start, stop, state, depth in starts:
        met = np.array([s for s in spans if s[0] < stop and s[1] >= start], np.int64).reshape(-1, 2)
        found += [e for e in J.elements_of(path, start, stop, state, depth, met, level, chunk)]
    return [json.loads(text) for _, text in sorted(found)]


@pytest.mark.parametrize("keys", [(), ("data", "hits")])
def test_any_width_of_ranges(tmp_path, keys):
    rng = random.Random(5)
    for case in range(25):
        elements = [value(rng) for _ in range(rng.randint(0, 8))]
        document = elements
        if keys:
            document = {"hits": [1, {"data": []}], "data": {"x": value(rng), "hits": elements, "more": [value(rng)]}, "z": value(rng)}
        text = json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        copies = rng.randint(1, 2)  # documents one after another
        body = ("\n".join([text] * copies)).encode()
        path = str(tmp_path / f"{len(keys)}-{case}.json")
        with open(path, "wb") as file:
            file.write(body)
        for width, chunk in ((1, 1), (2, 5), (7, 3), (64, 16), (len(body), 1 << 20)):
            assert cut_up(path, len(body), keys, width, chunk) == elements * copies, (case, width)


def test_files_and_tasks(spark, tmp_path):
    rows = [{"submitter_id": f'C"{i}\\', "primary_site": "[x], {y}", "diagnoses": [{"ajcc_pathologic_stage": "a,b"}]} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps(rows[:5], indent=2))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text(json.dumps({"data": {"hits": rows[:3]}}))
    whole = spark.read.schema(N.CASE_SCHEMA).option("multiLine", True).json([str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    want = sorted(map(tuple, N.flatten_cases(whole).collect()))
    for width in (2_000, 1 << 26):
        elements = J.read_elements(spark, str(tmp_path), range_bytes=width, chunk=700)
        assert sorted(map(tuple, N.flatten_cases(N.parse_documents(elements, "text", N.CASE_SCHEMA)).collect())) == want
    cut = J.read_elements(spark, str(tmp_path), range_bytes=20_000)
    tasks = cut.where("path like '%a.json'").selectExpr("spark_partition_id() as task").distinct().count()
    assert tasks > 4
    assert N.read_hits(spark, str(tmp_path), N.CASE_SCHEMA).count() == 3


def test_no_files(spark, tmp_path):
    assert J.read_elements(spark, str(tmp_path)).count() == 0


def test_ranges_read_little_past_their_end(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": i, "text": "x" * 200} for i in range(5000)]))
    size, read = path.stat().st_size, []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            data = self.file.read(n)
            read.append(len(data))
            return data

    class Disk:
        def open_input_file(self, name):
            return Counted(open(name, "rb"))

    monkeypatch.setattr(byte_files, "file_system", lambda name: (Disk(), name))
    whole, found = np.array([(0, size - 1)], np.int64), []
    for start in range(0, size, 20_000):
        stop, depth = min(start + 20_000, size), int(start > 0)
        state, change = J.sum_up(str(path), 0, start)[J.OUTSIDE] if start else (J.OUTSIDE, 0)
        read.clear()
        found += list(J.elements_of(str(path), start, stop, state, change if depth else 0, whole, 1))
        assert sum(read) <= 20_000 + byte_files.TAIL
    assert [json.loads(text)["id"] for _, text in found] == list(range(5000))


def test_many_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(30_000)]))
    cut = J.read_elements(spark, str(tmp_path), range_bytes=1_000)
    assert cut.count() == 30_000
    assert 4 < cut.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_array_files_grow_in_number(spark, tmp_path):
    texts = spark.range(1000).selectExpr("id as key", "to_json(named_struct('submitter_id', string(id))) as text")
    _array_files(texts, str(tmp_path / "x"), "[", "]", file_rows=50)
    files = [json.loads(f.read_text()) for f in (tmp_path / "x").glob("*/*.txt")]
    assert len(files) == 20 and max(map(len, files)) < 100
    assert sorted(int(e["submitter_id"]) for f in files for e in f) == list(range(1000))
