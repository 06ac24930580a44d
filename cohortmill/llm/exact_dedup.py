"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical without the characters space and U+0009 to U+000D.

1. *Combine.* Each task reads its rows through an open-addressing table that compares complete
   content. Copies collapse to one representative with the count and the best row, so a group
   that holds a third of all rows leaves one representative per task (and per table that was
   full), not one row per copy.
2. *Partition to spill files.* Representatives go to buckets by a hash of their digest and are
   written to the shared folder. A bucket is measured by the bytes of its distinct contents; the
   buckets that would not fit a table are partitioned again with another hash, level by level.
   Copies share a digest and count once, so every level shrinks what is left.
3. *Resolve.* Each bucket streams through one open-addressing table. Only distinct contents are
   held; copies are compared and counted as they pass.
4. Each row looks up its representative's group.

Spill files lie in the folder of ``spark.checkpoint.dir``, so a lost executor costs a retry only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import partitions, stored, text_or_empty

BLANKS = " \t\n\u000b\f\r"
TABLE_BYTES = 48 * 1024 * 1024

COMBINED = ("doc_id long, rep long, digest string, content string, bytes long, n long, "
            "best_chars int, best_id long")
RESOLVED = "rep long, keep_rep long, keep_id long, group_size long"


class ContentTable:
    """Open addressing with linear probing; equal means equal content, not equal hash."""

    def __init__(self):
        self.size, self.used, self.bytes = 1 << 10, 0, 0
        self.slots: list[int] = [-1] * self.size
        self.hashes: list[int] = []
        self.contents: list[str] = []

    def place(self, hashed: int, content: str) -> tuple[int, bool]:
        """Index of the content, and whether it is new."""
        at = hashed & (self.size - 1)
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == hashed and self.contents[found] == content:
                return found, False
            at = (at + 1) & (self.size - 1)
        self.slots[at] = index = self.used
        self.hashes.append(hashed)
        self.contents.append(content)
        self.used += 1
        self.bytes += len(content) + 100
        if 2 * self.used > self.size:
            self._grow()
        return index, True

    def _grow(self) -> None:
        self.size *= 2
        self.slots = [-1] * self.size
        for index, hashed in enumerate(self.hashes):
            at = hashed & (self.size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (self.size - 1)
            self.slots[at] = index


def better(chars: int, key: int | None, than_chars: int, than_key: int | None) -> bool:
    """More code points in the original text, then the smaller id; null ids come last."""
    if chars != than_chars:
        return chars > than_chars
    return key is not None and (than_key is None or key < than_key)


def _hash_of(digest: str) -> int:
    return int(digest[:15], 16)


def combine(batches: Iterator[pa.RecordBatch], table_bytes: int = TABLE_BYTES
            ) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, chars, digest, content) to one row each, copies pointing at representatives.

    Only a representative row carries content, count and best row.
    """
    from pyspark import TaskContext

    base, serial = TaskContext.get().partitionId() << 36, 0
    schema = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("digest", pa.string()),
                        ("content", pa.string()), ("bytes", pa.int64()), ("n", pa.int64()),
                        ("best_chars", pa.int32()), ("best_id", pa.int64())])

    def flush(table: ContentTable, heads: list[list], members: list[tuple]):
        rows = {"doc_id": [], "rep": [], "digest": [], "content": [], "bytes": [], "n": [],
                "best_chars": [], "best_id": []}
        for index, (rep, doc_id, digest, n, chars, best) in enumerate(heads):
            content = table.contents[index]
            for column, value in zip(rows.values(), (doc_id, rep, digest, content, len(content) + 100,
                                                     n, chars, best)):
                column.append(value)
            if len(rows["rep"]) == 2000:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)
                for column in rows.values():
                    column.clear()
        for at in range(0, len(members), 20000):
            part = members[at:at + 20000]
            yield pa.RecordBatch.from_pydict(
                {name: [m[i] for m in part] if i < 3 else [None] * len(part)
                 for i, name in enumerate(rows)}, schema=schema)
        if rows["rep"]:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    table, heads, members = ContentTable(), [], []
    for batch in batches:
        columns = (batch.column(n) for n in ("doc_id", "chars", "digest", "content"))
        for doc_id, chars, digest, content in zip(*(c.to_pylist() for c in columns)):
            index, new = table.place(_hash_of(digest), content)
            if new:
                heads.append([base + serial, doc_id, digest, 1, chars, doc_id])
                serial += 1
            else:
                head = heads[index]
                members.append((doc_id, head[0], digest))
                head[3] += 1
                if better(chars, doc_id, head[4], head[5]):
                    head[4], head[5] = chars, doc_id
            if table.bytes > table_bytes or len(members) > 500_000:
                yield from flush(table, heads, members)
                table, heads, members = ContentTable(), [], []
    yield from flush(table, heads, members)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives, bucket after bucket, to (rep, keep_rep, keep_id, group_size)."""
    schema = pa.schema([("rep", pa.int64()), ("keep_rep", pa.int64()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64())])
    bucket, table, groups, members = None, ContentTable(), [], []

    def flush():
        for at in range(0, len(members), 20000):
            part = members[at:at + 20000]
            yield pa.RecordBatch.from_pydict({
                "rep": [rep for rep, _ in part], "keep_rep": [groups[g][1] for _, g in part],
                "keep_id": [groups[g][3] for _, g in part],
                "group_size": [groups[g][0] for _, g in part]}, schema=schema)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in
                   ("bucket", "rep", "digest", "content", "n", "best_chars", "best_id")]
        for where, rep, digest, content, n, chars, best in zip(*columns):
            if where != bucket:
                yield from flush()
                bucket, table, groups, members = where, ContentTable(), [], []
            index, new = table.place(_hash_of(digest), content)
            if new:
                groups.append([n, rep, chars, best])
            else:
                group = groups[index]
                group[0] += n
                if better(chars, best, group[2], group[3]):
                    group[1:] = rep, chars, best
            members.append((rep, index))
    yield from flush()


def normalised(text: str) -> Column:
    return F.translate(text_or_empty(text), BLANKS, "")


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are copies of each other. Of a group the row with
    the most code points stays, then the smallest id; null ids come last. Rows that share that id
    are all marked kept, as nothing tells them apart. Other columns take no part. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    content = normalised(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.length(text_or_empty(text)).alias("chars"), content.alias("content"))
    rows = rows.select("doc_id", "chars", F.sha2("content", 256).alias("digest"), "content")
    combined = stored(rows.mapInArrow(lambda b: combine(b, table_bytes), COMBINED), "combined")

    left, level, found = combined.where("content is not null"), 0, []
    while True:
        sizes = left.groupBy("digest").agg(F.max("bytes").alias("bytes"))
        total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        buckets = max(2 * -(-total // table_bytes), partitions(spark))

        def bucket(digest, level=level, buckets=buckets):
            return F.pmod(F.xxhash64(digest, F.lit(level)), F.lit(buckets))

        large = (sizes.groupBy(bucket(F.col("digest")).alias("bucket"))
                 .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("contents"))
                 .where((F.col("bytes") > table_bytes) & (F.col("contents") > 1)))
        spread = left.withColumn("bucket", bucket(F.col("digest")))
        over = [r[0] for r in large.select("bucket").limit(1).collect()]
        fitting = spread.join(large, "bucket", "left_anti") if over else spread
        found.append(fitting.select("bucket", "rep", "digest", "content", "n", "best_chars", "best_id")
                     .repartitionById(buckets, F.col("bucket").cast("int"))
                     .mapInArrow(resolve, RESOLVED))
        if not over:
            break
        left = stored(spread.join(large, "bucket", "left_semi").drop("bucket"), "spill")
        level += 1
    groups = found[0]
    for more in found[1:]:
        groups = groups.unionByName(more)
    joined = combined.select("doc_id", "rep", "digest").join(groups, "rep")
    return joined.select("doc_id", "keep_id", "group_size",
                         F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that share id and content, one."""
    found = stored(decisions(docs, doc_id, text), "decisions")
    kept = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("rows__"))
    key = F.col(doc_id).cast("long").eqNullSafe(F.col("doc_id__"))
    single = kept.where("rows__ = 1").select(F.col("doc_id").alias("doc_id__"))
    several = kept.where("rows__ > 1").select(F.col("doc_id").alias("doc_id__"))
    if several.limit(1).count() == 0:
        return docs.join(single, key, "left_semi")
    # an id that several groups or rows share: match by content as well
    longest = F.struct((-F.length(text_or_empty(text))).alias("a"), F.xxhash64(*docs.columns).alias("b"))
    chosen = (docs.join(several, key, "left_semi")
              .withColumn("digest__", F.sha2(normalised(text), 256))
              .join(found.where("kept").select(F.col("doc_id").alias("doc_id__"),
                                               F.col("text_sha256").alias("sha__")).distinct(),
                    key & (F.col("digest__") == F.col("sha__")), "left_semi"))
    one = chosen.groupBy(doc_id, "digest__").agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), longest).alias("row__"))
    return docs.join(single, key, "left_semi").unionByName(one.select("row__.*"))
