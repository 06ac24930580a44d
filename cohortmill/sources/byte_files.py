"""Files read as bytes in tasks: digests of any size, and byte ranges.

A file is never one value. Tasks open it through a URI (local paths, hdfs, s3) and hold one chunk.
Names and sizes are listed on the driver, as Spark's own file index does; contents never pass it.
Byte ranges of a file of zstd frames (``framed``) are ranges of its decompressed bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortmill.sources import framed

CHUNK = 4 * 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024
DEAL_BYTES = 64 * 1024 * 1024
TAIL = 16 * 1024


def file_system(path: str):
    """(file system, path on it) of a URI or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of every file below ``path`` in order; hidden names are left out, as Spark does."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(
        root).type == fs.FileType.Directory else [system.get_file_info(root)]
    prefix = path[:len(path) - len(root)] if path.endswith(root) else ""
    return sorted((prefix + f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not any(map(is_hidden, f.path[len(root):].split("/"))))


def is_hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


class FileGroup(InputPartition):
    """Files that one task reads one after the other."""

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class DigestReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.algorithm = options.get("algorithm", "md5")
        self.chunk = int(options.get("chunkBytes", CHUNK))
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[FileGroup]:
        """Small files share a task up to ``taskBytes``; a larger file has a task of its own."""
        groups, held = [[]], 0
        for name, size in list_files(self.path):
            if groups[-1] and held + size > self.task_bytes:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [FileGroup(names) for names in groups]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        for name in partition.files:
            yield (name, name.rsplit("/", 1)[-1], *self._digest(name))

    def _digest(self, name: str) -> tuple[int | None, str | None, str | None]:
        """(size, digest, problem): a file that cannot be read is a row, not an end of the job."""
        digest, size = hashlib.new(self.algorithm), 0
        try:
            system, path = file_system(name)
            with system.open_input_stream(path, compression=None) as stream:
                while chunk := stream.read(self.chunk):
                    digest.update(chunk)
                    size += len(chunk)
        except OSError as problem:
            return None, None, f"{type(problem).__name__}: {problem}"
        return size, digest.hexdigest(), None


class FileDigests(DataSource):
    """One row per file below ``path``: its size and digest, read in chunks of bounded size.

    Options: ``path``, ``algorithm`` (md5), ``chunkBytes``, ``taskBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, file_name string, size bigint, digest string, problem string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


def read_digests(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, file_name, size, digest, problem) of every file below ``path``, whatever its size.

    ``problem`` says why a file could not be read; its size and digest are null then.
    """
    spark.dataSource.register(FileDigests)
    reader = spark.read.format("file_digests").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def byte_ranges(spark: SparkSession, path: str, range_bytes: int) -> tuple[DataFrame, int]:
    """(path, start, stop) of ranges that cover every file below ``path``, and in how many tasks to read
    them: one to each while they are few, else neighbours together up to ``DEAL_BYTES``."""
    files = [f for f in _unpacked(spark, list_files(path)) if f[1]]
    number = sum(-(-size // range_bytes) for _, size in files)
    full = -(-sum(size for _, size in files) // DEAL_BYTES)
    starts = spark.createDataFrame(files, "path string, size long").withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))))
    return (starts.select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("stop")),
            min(number, max(full, 4 * spark.sparkContext.defaultParallelism)))


def _unpacked(spark: SparkSession, files: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The files with the sizes of their decompressed bytes; the tables that tell them are read in tasks."""
    names = [(name,) for name, size in files if size and framed.is_framed(name)]
    if not names:
        return files

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                with open_bytes(name) as file:
                    found.append(file.size())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["path", "size"])

    known = dict(map(tuple, spark.createDataFrame(names, "path string").mapInArrow(sizes, "path string, size long").collect()))
    return [(name, known.get(name, size)) for name, size in files]


def open_bytes(path: str):
    """A file to seek in and read from; one of zstd frames by its decompressed bytes."""
    system, name = file_system(path)
    file = system.open_input_file(name)
    return framed.Reader(file, path) if framed.is_framed(name) else file


def dealt(ranges: DataFrame, tasks: int, most: int = 20_000) -> DataFrame:
    """Ranges dealt to tasks in order, about as many to each."""
    return ranges.repartitionByRange(max(1, min(tasks, most)), "path", "start")


def chunks_from(path: str, start: int, stop: int | None = None, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes from ``start`` up to ``stop`` (to the end of the file if none)."""
    with open_bytes(path) as file:
        file.seek(start)
        left = (stop - start) if stop is not None else None
        while left is None or left > 0:
            data = file.read(chunk if left is None else min(chunk, left))
            if not data:
                return
            if left is not None:
                left -= len(data)
            yield data


def chunks_past(path: str, start: int, stop: int, chunk: int = CHUNK, tail: int = TAIL) -> Iterator[bytes]:
    """The bytes from ``start`` up to ``stop``, then those up to the end of the file in chunks that
    grow from ``tail``: a reader that only finishes what it has begun reads little past its range."""
    yield from chunks_from(path, start, stop, chunk)
    with open_bytes(path) as file:
        file.seek(stop)
        size = min(tail, chunk)
        while data := file.read(size):
            yield data
            size = min(2 * size, chunk)
