"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive starts with a skippable frame that holds its dictionary, trained on records of that
archive; each record is then one Zstandard frame that uses it, so a reader can open any record
alone. Equal payloads are stored once: the record with the smallest page id is the response,
the others are revisit records that name it.

Equal payloads are found by a grouped digest, pre-aggregated before the shuffle; only payloads
that occur more than once join back, as a measured broadcast or a join that splits hot keys.
Each task writes its rows to archives of bounded size and holds one record batch and one
archive's training sample at a time. Archives go to the shared folder under a name of their own
per attempt; the list of finished archives is stored, so lost tasks leave no doubt.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.llm.common import new_folder, stored
from cohortmill.session import broadcast_if_small

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
ARCHIVE_BYTES = 64 * 1024 * 1024
SAMPLE_BYTES = 2 * 1024 * 1024
DICTIONARY_BYTES = 64 * 1024
PIECE_BYTES = 64 * 1024  # longer records are several training samples
LEVEL = 3
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDED = "path string, records long, bytes long, raw_bytes long"
READ = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, payload binary")


def payload(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def with_record_type(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                     least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` with record_type and refers_to (and payload_digest, payload_bytes).

    Of equal payloads of at least ``least`` bytes the one with the smallest page id is the
    response; rows that share that id are all responses. Null ids come last: they revisit the
    smallest id, and without one they are responses.
    """
    body = payload(html)
    pages = pages.withColumns({"payload_digest": F.sha2(body, 256),
                               "payload_bytes": F.octet_length(body).cast("long")})
    repeated = (pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
                .agg(F.min(F.col(page_id).cast("long")).alias("first__"), F.count("*").alias("rows__"))
                .where(F.col("rows__") > 1).select("payload_digest", "first__"))
    joined = pages.join(broadcast_if_small(repeated), "payload_digest", "left")
    revisit = (F.col("first__").isNotNull()
               & ~F.col(page_id).cast("long").eqNullSafe(F.col("first__")))
    return joined.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("first__"))}).drop("first__")


def header_value(value: str) -> str:
    """Without line ends and other controls, which would end a header line."""
    return "".join(c if c >= " " and c != "%" and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def header_text(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str,
           body: bytes, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only, whose length names the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """The row of a record: of a revisit the payload is null, its length and digest are known."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length:"))
    if fields["WARC-Type"] == "revisit":
        body = None
    elif len(body) != size:
        raise ValueError("a record is cut short")
    own, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    url = fields.get("WARC-Target-URI")
    return (None if own is None else int(own), None if url is None else header_text(url),
            fields["WARC-Type"], None if refers is None else int(refers), size,
            fields["WARC-Payload-Digest"].split(":", 1)[1], body)


def trained(records: list[bytes]) -> bytes:
    """A dictionary from records, long ones in pieces; empty where there are too few to train one."""
    import zstandard

    samples = [raw[at:at + PIECE_BYTES] for raw in records for at in range(0, len(raw), PIECE_BYTES)]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """One archive: records wait until the sample is full, then the dictionary goes first."""

    def __init__(self, folder: str):
        self.folder, self.waiting, self.waiting_bytes = folder, [], 0
        self.compressor, self.file = None, None
        self.records = self.bytes = self.raw_bytes = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.raw_bytes += len(raw)
        if self.compressor is None:
            self.waiting.append(raw)
            self.waiting_bytes += len(raw)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._open()
        else:
            self._write(self.compressor.compress(raw))

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def _open(self) -> None:
        import zstandard
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{self.folder}/{name}"
        self.file = system.open_output_stream(f"{folder}/{name}", compression=None)
        dictionary = trained(self.waiting)
        self._write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if given:
            given.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=given)
        for raw in self.waiting:
            self._write(self.compressor.compress(raw))
        self.waiting = []

    def close(self) -> tuple:
        if self.compressor is None:
            self._open()
        self.file.close()
        return self.path, self.records, self.bytes, self.raw_bytes


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
          html: str = "html", date: str = "2024-01-01T00:00:00Z",
          archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all rows below ``folder`` (a URI that pyarrow opens); one row per archive.

    Null payloads are empty, null URLs have no target header. An empty table writes no archive.
    """
    rows = with_record_type(pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    rows = rows.select("page_id", "url", "record_type", "refers_to", "payload_digest",
                       payload("html").alias("payload"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                        ("raw_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, finished = None, []
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "record_type", "refers_to",
                                                 "payload_digest", "payload")]
            for at in range(batch.num_rows):
                archive = archive or ArchiveWriter(folder)
                archive.add(record(*(c[at].as_py() for c in columns), date))
                if archive.raw_bytes >= archive_bytes:
                    finished.append(archive.close())
                    archive = None
        if archive:
            finished.append(archive.close())
        for row in finished:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

    _make_folder(folder)
    return stored(rows.mapInArrow(run, RECORDED), "archives")


def _make_folder(folder: str) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time.

    A frame's end is known only after it is decompressed, so input is fed in blocks and what a
    frame leaves unused starts the next one.
    """
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("an archive lacks its dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("an archive does not start with a dictionary frame")
    dictionary = stream.read(size)
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor = zstandard.ZstdDecompressor(dict_data=given)
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 18)
            if not rest:
                return
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(1 << 18)
            if not rest:
                raise ValueError("an archive is cut short")
        yield b"".join(parts)


def read(archives: DataFrame, path: str = "path") -> DataFrame:
    """Every record of the listed archives: page id, url, type, refers_to, payload facts, payload.

    Archives are dealt out one by one and streamed, whatever their size.
    """
    names = [f.split(" ")[0] for f in READ.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(path).to_pylist():
                system, where = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with system.open_input_stream(where, compression=None) as stream:
                    for raw in frames(stream):
                        rows.append(parsed(raw))
                        held += len(raw)
                        if held >= 8 * 1024 * 1024:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)

    n = max(archives.count(), 1)
    return archives.select(path).repartition(n).mapInArrow(run, READ)


def archive_folder(spark: SparkSession) -> str:
    folder = new_folder(spark, "warc")
    return folder if ":" in folder.split("/")[0] else f"file://{folder}"
