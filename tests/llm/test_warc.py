"""Round trips through dictionary-compressed archives."""

import hashlib

import pytest

from cohortmill.llm import warc

ROWS = "page_id long, url string, html string, path string"


def round_trip(spark, rows, **options):
    pages = spark.createDataFrame(rows, ROWS)
    return warc.read(warc.write(pages, warc.archive_folder(spark), **options)).collect()


def test_records_come_back(spark):
    body = "<p>é " + "x" * 200 + "</p>"
    rows = [(3, "http://a/\r\nX: y%41", body, "p"), (1, None, body, "p"), (2, "http://b", body, "p"),
            (4, "http://c", None, "p"), (5, "http://d", "", "p"), (6, "u", "short", "p"), (7, "u", "short", "p"),
            (None, "n", body, "p"), (8, "u", "é" * 50, "p"), (9, "u", "é" * 50, "p"), (10, "u", "z" * 3_000_000, "p")]
    got = {r["page_id"]: r for r in round_trip(spark, rows)}
    assert len(got) == len(rows)
    for page, url, html, _ in rows:
        raw = (html or "").encode()
        row = got[page]
        assert (row["url"], row["payload_bytes"]) == (url, len(raw))
        assert row["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert row["payload"] is None if row["record_type"] == "revisit" else bytes(row["payload"]) == raw
    assert {p: r["refers_to"] for p, r in got.items() if r["record_type"] == "revisit"} == {
        2: 1, 3: 1, None: 1, 9: 8}


def test_dictionary_is_used_and_archives_are_bounded(spark):
    rows = [(i, f"http://h/{i}", f"<html><head><title>page {i}</title></head><body>{'lorem ipsum ' * 20}{i * 7919}"
             "</body></html>", "p") for i in range(4000)]
    pages = spark.createDataFrame(rows, ROWS).coalesce(1)
    archives = warc.write(pages, warc.archive_folder(spark), archive_bytes=1_000_000)
    files = archives.collect()
    assert len(files) > 1 and sum(f["records"] for f in files) == 4000
    with open(files[0]["path"].removeprefix("file://"), "rb") as file:
        magic, size = int.from_bytes(file.read(4), "little"), int.from_bytes(file.read(4), "little")
    assert magic == warc.SKIPPABLE and 0 < size <= warc.DICTIONARY_BYTES
    assert sorted(r["page_id"] for r in warc.read(archives).collect()) == list(range(4000))


def test_empty_table_and_repeated_rows(spark):
    assert warc.write(spark.createDataFrame([], ROWS), warc.archive_folder(spark)).count() == 0
    got = round_trip(spark, [(1, "u", "a" * 100, "p")] * 3)
    assert [(r["record_type"], r["refers_to"]) for r in got] == [("response", None)] * 3


def test_damage_is_noticed():
    import io

    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"1234567890")))


def test_large_pages_do_not_cost_an_archive_its_dictionary(tmp_path):
    import random
    import struct

    words = [f"word{i}" for i in range(3000)]
    page = lambda seed, size: " ".join(random.Random(seed).choices(words, k=size // 8)).encode()
    for pages in ([page(1, 3_000_000), *(page(i, 2000) for i in range(2, 40))], [page(i, 500_000) for i in range(9)],
                  [page(i, 200_000) for i in range(5)]):
        writer = warc.ArchiveWriter(f"file://{tmp_path}")
        for body in pages:
            writer.add(body)
        path, records, _, raw_bytes = writer.close()
        with open(path.removeprefix("file://"), "rb") as stream:
            assert struct.unpack("<II", stream.read(8))[1] > 0
            stream.seek(0)
            assert list(warc.frames(stream)) == pages
        assert records == len(pages) and raw_bytes == sum(map(len, pages))
