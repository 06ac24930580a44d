"""Files of zstd frames: any range of their bytes, and JSON arrays in them."""

from __future__ import annotations

import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortmill.plans import source_queries as S
from cohortmill.sources import byte_files, framed
from cohortmill.sources import json_arrays as J
from cohortmill.sources import nested as N


def pack(path, data, frame_bytes, pieces=1):
    writer = framed.Writer(open(path, "wb"), frame_bytes)
    for i in range(pieces):
        writer.write(data[len(data) * i // pieces:len(data) * (i + 1) // pieces])
    writer.close()


@pytest.mark.parametrize("size", [0, 1, 99, 100, 101, 5000])
def test_any_range_of_a_framed_file(tmp_path, size):
    rng = random.Random(size)
    data, path = rng.randbytes(size), str(tmp_path / "a.zst")
    pack(path, data, 100, pieces=7)
    with byte_files.open_bytes(path) as file:
        assert file.size() == size
        for _ in range(200):
            at, n = rng.randint(0, size + 5), rng.randint(1, 400)
            file.seek(at)
            assert file.read(n) == data[at:at + n]
            assert file.read(n) == data[at + n:at + 2 * n]
    for chunk in (30, 100, 1000):
        assert b"".join(byte_files.chunks_from(path, 3, 700, chunk)) == data[3:700]
        assert b"".join(byte_files.chunks_past(path, 3, 700, chunk, tail=10)) == data[3:]


def test_a_long_table_is_read_whole(tmp_path):
    data, path = random.Random(1).randbytes(30_000), str(tmp_path / "a.zst")
    pack(path, data, 7)  # a table of some 34 KB
    assert b"".join(byte_files.chunks_from(path, 29_000)) == data[29_000:]


def test_any_tool_unpacks_a_framed_file(tmp_path):
    data, path = b"abc" * 1000, str(tmp_path / "a.zst")
    pack(path, data, 100)
    packed = open(path, "rb").read()
    zstandard = pytest.importorskip("zstandard")
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(packed), read_across_frames=True).read() == data


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "a.zst"
    path.write_bytes(pa.compress(b"[1, 2]", codec="zstd", asbytes=True))
    with pytest.raises(ValueError, match="a.zst"):
        byte_files.open_bytes(str(path))


def test_a_range_reads_its_frames_only(tmp_path):
    path, read = str(tmp_path / "a.zst"), []
    data = random.Random(2).randbytes(1 << 20)
    pack(path, data, 1 << 12)
    with open(path, "rb") as file:
        class Counted:
            size, seek = staticmethod(lambda: len(packed)), file.seek

            def read(self, n):
                read.append(n)
                return file.read(n)

        packed = open(path, "rb").read()
        reader = framed.Reader(Counted())
        read.clear()
        reader.seek(100_000)
        got = b"".join(reader.read(1000) for _ in range(50))
    assert got == data[100_000:150_000] and sum(read) < 50_000 + 3 * (1 << 12)


def test_elements_of_framed_and_plain_files(spark, tmp_path):
    rows = [{"submitter_id": f'C"{i}\\', "primary_site": "[x], {y}é", "diagnoses": [{"ajcc_pathologic_stage": "a,b"}]} for i in range(2000)]
    pack(tmp_path / "a.json.zst", json.dumps({"x": [1], "data": {"hits": rows[:1500]}}).encode(), 1000)
    (tmp_path / "b.json").write_text(json.dumps({"data": {"hits": rows[1500:]}}))
    pack(tmp_path / "c.json.zst", b"", 1000)
    (tmp_path / "d.json.zst").write_bytes(b"")
    for width in (2_000, 1 << 26):
        found = J.read_elements(spark, str(tmp_path), ("data", "hits"), range_bytes=width, chunk=700).select("text").collect()
        assert sorted(r[0] for r in found) == sorted(json.dumps(r) for r in rows)


def lines(spark, path, n, partitions):
    spark.range(0, n, 1, partitions).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (F.xxhash64("id") % 20_000).alias("l_partkey"), (F.col("id") % 997).alias("l_suppkey"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag")).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_pages_lie_compressed_on_disk(spark, tmp_path, monkeypatch):
    sf_dir = lines(spark, tmp_path, 30_000, 2)
    monkeypatch.setattr(S, "_folder", lambda spark, name: str(tmp_path / name))
    found = S.hits_of_response_pages(spark, sf_dir)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, S.flatten_file_hits(spark, sf_dir).collect()))
    sizes = [f.stat().st_size for f in (tmp_path / "pages").rglob("*") if f.is_file()]
    texts = S._hit_documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0]
    assert len(sizes) >= 5 and sum(sizes) < texts / 5


def test_pages_of_repeated_rows_and_of_none(spark, tmp_path, monkeypatch):
    once = spark.read.parquet(f"{lines(spark, tmp_path / 'once', 40, 1)}/lineitem.parquet")
    once.union(once).write.parquet(str(tmp_path / "twice" / "lineitem.parquet"))
    once.limit(0).write.parquet(str(tmp_path / "none" / "lineitem.parquet"))
    for name, n in (("twice", 74), ("none", 0)):
        monkeypatch.setattr(S, "_folder", lambda spark, kind: str(tmp_path / name / kind))
        assert S.hits_of_response_pages(spark, str(tmp_path / name)).count() == n


def test_pages_are_of_bounded_length(spark, tmp_path):
    texts = spark.range(0, 1000, 1, 3).selectExpr("id as key", "to_json(named_struct('submitter_id', string(id))) as text")
    S._framed_array_files(texts, str(tmp_path / "x"), "[", "]", file_rows=50)
    files = sorted((tmp_path / "x").iterdir())
    pages = [json.loads(b"".join(byte_files.chunks_from(str(f), 0))) for f in files]
    assert len(pages) == 21 and max(map(len, pages)) == 50
    assert sorted(int(e["submitter_id"]) for p in pages for e in p) == list(range(1000))
    assert N.read_documents(spark, str(tmp_path / "x"), N.CASE_SCHEMA, range_bytes=300).count() == 1000
