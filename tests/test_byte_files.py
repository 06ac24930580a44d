"""Digests of files of any size."""

import hashlib

from pyspark.sql import functions as F

from cohortmill.sources import byte_files, files
from tests.conftest import rows_as


def test_digests_equal_those_of_whole_contents(spark, tmp_path):
    made = {"a.bin": b"", "b.gz": b"\x1f\x8b not really compressed", "sub/c.tsv": b"x\ty\n" * 50_000, "sub/k=1/d": b"\x00" * 10}
    for name, body in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for hidden in ("_SUCCESS", ".a.bin.crc", "sub/_temporary"):
        (tmp_path / hidden).write_bytes(b"hidden")
    want = sorted((n.rsplit("/", 1)[-1], len(b), hashlib.md5(b).hexdigest(), None) for n, b in made.items())
    for options in ({}, {"chunkBytes": 7, "taskBytes": 1}, {"taskBytes": 1 << 40}):
        found = byte_files.read_digests(spark, str(tmp_path), **options)
        assert rows_as(found, "file_name", "size", "digest", "problem") == want
    assert byte_files.read_digests(spark, f"file://{tmp_path}").count() == len(made)
    whole = files.read_files(spark, str(tmp_path))
    metadata = whole.select("file_name", F.md5("content").alias("md5sum"), F.col("size").alias("file_size"))
    both = [files.integrity(f, metadata.unionByName(spark.createDataFrame([("gone", "x", 1)], metadata.schema)))
            for f in (whole, byte_files.read_digests(spark, str(tmp_path)))]
    assert rows_as(both[0]) == rows_as(both[1])
    assert byte_files.read_digests(spark, str(tmp_path), algorithm="sha256").where(
        F.col("digest") == hashlib.sha256(made["sub/c.tsv"]).hexdigest()).count() == 1


def test_a_file_beyond_the_size_of_a_value(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "sparse.bin", "wb") as file:
        file.truncate(size)
    row = byte_files.read_digests(spark, str(tmp_path)).first()
    digest = hashlib.md5()
    for _ in range(size >> 24):
        digest.update(bytes(1 << 24))
    assert (row["size"], row["digest"], row["problem"]) == (size, digest.hexdigest(), None)


def test_unreadable_files_are_rows(spark, tmp_path):
    reader = byte_files.DigestReader({"path": str(tmp_path)})
    (tmp_path / "a").write_text("x")
    names = reader.partitions()
    (tmp_path / "a").unlink()
    path, name, size, digest, problem = next(reader.read(names[0]))
    assert name == "a" and size is digest is None and "No such file" in problem
    found = spark.createDataFrame([("a", None, None, problem)], "file_name string, size long, digest string, problem string")
    expected = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "file_name string, md5sum string, file_size long")
    rows = files.integrity(found, expected)
    assert rows_as(rows, "file_name", "status", "verified") == [("a", "unreadable", False), ("b", "missing", False)]


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert byte_files.read_digests(spark, str(tmp_path)).count() == 0
