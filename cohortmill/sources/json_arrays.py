"""JSON arrays read by byte ranges, one row per element.

A JSON file can be cut anywhere as long as each piece knows what it starts in: inside a string or
not, right after a backslash or not, and how deep in brackets. Three passes over ranges of bytes,
each in parallel:

1. Every range is summed up for each of the three lexical states it may start in: the state it ends
   in and the change of depth. A prefix pass over the sums of a file, a row per range, gives the
   state in which each range really starts.
2. Brackets down to the depth of the wanted array give the outline of a file, and with the keys
   before them the byte spans of the arrays that lie at the wanted path.
3. Every range cuts the elements that begin in it, and reads on past its end to finish the last one.

Memory is a chunk of bytes and one element, however long the file is. Files are UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.session import materialize
from cohortmill.sources.byte_files import CHUNK, byte_ranges, chunks_from, chunks_past, dealt

RANGE_BYTES = 64 * 1024 * 1024
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2  # not in a string, in one, in one after a backslash
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
STEP = np.zeros(256, np.int64)
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
MARK = STEP != 0
MARK[COMMA] = True
KEY_BYTES = 4096
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


def unescaped_quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Positions of quotes without an odd number of backslashes before them, and whether the byte
    after the data is escaped. ``escaped`` says so of its first byte."""
    quotes = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH)
    if not len(slashes):
        return (quotes[1:] if escaped and len(quotes) and quotes[0] == 0 else quotes), escaped and not len(data)
    firsts = np.r_[True, np.diff(slashes) != 1]
    start = slashes[firsts]
    end = slashes[np.r_[firsts[1:], True]] + 1
    odd = (end - start) % 2 == 1
    after = end[odd]
    if escaped and start[0] == 0:
        after = after[1:] if odd[0] else np.r_[end[:1], after]
    elif escaped:
        after = np.r_[0, after]
    return quotes[~np.isin(quotes, after)], bool(len(after) and after[-1] == len(data))


def outside_marks(data: np.ndarray, state: int, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions of ``wanted`` bytes outside strings, and the state after the data."""
    quotes, escaped = unescaped_quotes(data, state == ESCAPED)
    marks = np.flatnonzero(wanted[data])
    within = (np.searchsorted(quotes, marks) + (state != OUTSIDE)) % 2 == 1
    if (len(quotes) + (state != OUTSIDE)) % 2 == 0:
        return marks[~within], OUTSIDE
    return marks[~within], ESCAPED if escaped else INSIDE


def sum_up(path: str, start: int, stop: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """(state at the end, change of depth) of a range for each state at its start."""
    sums = [(OUTSIDE, 0), (INSIDE, 0), (ESCAPED, 0)]
    for data in chunks_from(path, start, stop, chunk):
        data = np.frombuffer(data, np.uint8)
        step: dict[int, tuple[int, int]] = {}
        for state in {s for s, _ in sums}:
            marks, after = outside_marks(data, state, STEP != 0)
            step[state] = after, int(STEP[data[marks]].sum())
        sums = [(step[s][0], depth + step[s][1]) for s, depth in sums]
    return sums


def outline_of(path: str, start: int, stop: int, state: int, depth: int, deepest: int, chunk: int = CHUNK
               ) -> Iterator[tuple[int, str, int, str | None]]:
    """(position, bracket, depth it opens or closes, key before it) down to ``deepest``."""
    at = start
    for raw in chunks_from(path, start, stop, chunk):
        data = np.frombuffer(raw, np.uint8)
        marks, state = outside_marks(data, state, STEP != 0)
        steps = STEP[data[marks]]
        after = depth + np.cumsum(steps)
        level = np.where(steps > 0, after, after + 1)
        for i in np.flatnonzero(level <= deepest):
            position = at + int(marks[i])
            key = _key_before(path, position) if steps[i] > 0 and level[i] > 1 else None
            yield position, chr(data[marks[i]]), int(level[i]), key
        depth = int(after[-1]) if len(after) else depth
        at += len(raw)


def _key_before(path: str, position: int) -> str | None:
    found = KEY.search(b"".join(chunks_from(path, max(0, position - KEY_BYTES), position)))
    return found.group(1).decode("utf-8", "replace") if found else None


def array_spans(events: list[tuple[int, str, int, str | None]], keys: Sequence[str]) -> list[tuple[int, int]]:
    """(position of [, position of ]) of the arrays that lie at ``keys`` of a document."""
    spans, names, opened = [], [], None
    for position, bracket, level, key in sorted(events):
        if bracket in "[{":
            names = names[:level - 1] + [key if bracket == "{" or level == len(keys) + 1 else None]
            if bracket == "[" and level == len(keys) + 1 and names[1:] == list(keys):
                opened = position
        elif opened is not None and bracket == "]" and level == len(keys) + 1:
            spans.append((opened, position))
            opened = None
    return spans


def elements_of(path: str, start: int, stop: int, state: int, depth: int, spans: np.ndarray, level: int,
                chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the elements that begin in a range, in arrays at ``level``."""
    at, held, begun = start, [], None
    for raw in chunks_past(path, start, stop, chunk):
        data = np.frombuffer(raw, np.uint8)
        marks, state = outside_marks(data, state, MARK)
        steps = STEP[data[marks]]
        after = depth + np.cumsum(steps)
        place = at + marks
        of_span = np.searchsorted(spans[:, 0], place, side="right") - 1
        inside = (of_span >= 0) & (place <= spans[np.maximum(of_span, 0), 1]) if len(spans) else np.zeros(len(place), bool)
        comma = (steps == 0) & (after == level)
        edge = np.flatnonzero(inside & (comma | (place == spans[np.maximum(of_span, 0), 0])
                                        | (place == spans[np.maximum(of_span, 0), 1]))) if inside.any() else []
        for i in edge:
            position = int(place[i])
            if begun is not None:
                element = b"".join([*held, raw[max(begun - at, 0):position - at]]).strip()
                if element:
                    yield begun, element
            held, begun = [], None
            if steps[i] >= 0:
                if position >= stop:
                    return
                begun = position + 1
        depth = int(after[-1]) if len(after) else depth
        if begun is not None:
            held.append(raw[max(begun - at, 0):])
        at += len(raw)
        if begun is None and at >= stop:
            return


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()),
         "array<long>": pa.list_(pa.int64())}


def _per_range(ranges: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of`` (a generator over one range's values) of every range, in batches of bounded size."""
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, schema.split(","))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for one in (row for given in batches for row in given.to_pylist()):
            for row in rows_of(one):
                rows.append(row)
                size += 100 + sum(len(v) for v in row if isinstance(v, str))
                if size > CHUNK:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return ranges.mapInArrow(run, schema)


def starting_states(ranges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ranges (path, start, stop) with the lexical state and the depth in which they start."""
    sums = _per_range(ranges, "path string, start long, stop long, ends array<int>, steps array<long>", lambda r: [
        (r["path"], r["start"], r["stop"], *map(list, zip(*sum_up(r["path"], r["start"], r["stop"], chunk))))])

    arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("state", pa.int32()), ("depth", pa.int64())])

    def prefix(file: pa.Table) -> pa.Table:
        state, depth, found = OUTSIDE, 0, []
        for row in sorted(file.to_pylist(), key=lambda r: r["start"]):
            found.append({"path": row["path"], "start": row["start"], "stop": row["stop"], "state": state, "depth": depth})
            state, depth = row["ends"][state], depth + row["steps"][state]
        return pa.Table.from_pylist(found, schema=arrow)

    # a row per range of a file: a terabyte has some sixteen thousand
    return materialize(sums).groupBy("path").applyInArrow(prefix, "path string, start long, stop long, state int, depth long")


def read_elements(spark: SparkSession, path: str, keys: Sequence[str] = (), range_bytes: int = RANGE_BYTES,
                  chunk: int = CHUNK) -> DataFrame:
    """(path, position, text) of every element of the arrays at ``keys`` in the files below ``path``.

    Without keys the array is the whole document; ``("data", "hits")`` is the array under ``hits`` of
    the object under ``data``. A file may hold several documents after another. A file without
    such an array gives no rows.
    """
    ranges, tasks = byte_ranges(spark, path, range_bytes)
    if not tasks:
        return spark.createDataFrame([], "path string, position long, text string")
    level = len(keys) + 1
    states = materialize(dealt(starting_states(dealt(ranges, tasks), chunk), tasks))
    outline = _per_range(states, "path string, position long, bracket string, level int, key string", lambda r: (
        (r["path"], *event) for event in outline_of(r["path"], r["start"], r["stop"], r["state"], r["depth"], level, chunk)))

    def find(file: pa.Table) -> pa.Table:
        events = [(r["position"], r["bracket"], r["level"], r["key"]) for r in file.to_pylist()]
        spans = array_spans(events, keys)
        return pa.table({"path": pa.array([file.column("path")[0].as_py()] * len(spans), pa.string()),
                         "opened": pa.array([s for s, _ in spans], pa.int64()), "closed": pa.array([e for _, e in spans], pa.int64())})

    spans = materialize(outline.groupBy("path").applyInArrow(find, "path string, opened long, closed long"))
    met = states.join(spans, "path").where("opened < stop and closed >= start").groupBy(*states.columns).agg(
        F.sort_array(F.collect_list(F.struct("opened", "closed"))).alias("spans"))

    def cut(r: dict) -> Iterator[tuple]:
        known = np.array([(s["opened"], s["closed"]) for s in r["spans"]], np.int64).reshape(-1, 2)
        for position, text in elements_of(r["path"], r["start"], r["stop"], r["state"], r["depth"], known, level, chunk):
            yield r["path"], position, text.decode("utf-8", "replace")

    return _per_range(dealt(met, tasks), "path string, position long, text string", cut)
