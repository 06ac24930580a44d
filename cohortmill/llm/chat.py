"""Chat formatting by token-level assembly.

Segments (role, text) are encoded apart, and the template's marks are spliced in as reserved ids
above the tokenizer's own, so no content can ever produce a mark. Loss masks are prefix sums of
+1 where a trained segment starts and -1 where it ends. For renderings as text, control strings
in content are escaped: every ``<`` followed by bars gets one more bar, which cannot form a
control string and is undone by removing one.

Rows are formatted one by one, in parallel. Only what is asked of whole conversations streams
over them in turn order, with one turn in memory, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.bpe import vocabulary

MARKS = ("<|im_start|>", "\n", "<|im_end|>\n")
ESCAPABLE = re.compile(r"<(\|+)")
ESCAPED = re.compile(r"<\|(\|+)")


def escape(text: str) -> str:
    return ESCAPABLE.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1", text)


def marks(path: str) -> tuple[int, int, int]:
    """Reserved ids: start of a turn, end of its role, end of the turn."""
    size = vocabulary(path).size
    return size, size + 1, size + 2


def assembled(roles: list[str], texts: list[str], path: str, trained_role: str) -> tuple[list[bytes], list[bytes]]:
    """Packed ids and loss masks (one byte a token) of each turn."""
    words, (start, middle, end) = vocabulary(path), marks(path)
    encoded = words.encode_all([escape(x) for pair in zip(roles, texts) for x in pair])
    sizes = np.array([len(e) // 4 for e in encoded], np.int64).reshape(-1, 2)
    starts = np.concatenate([[0], np.cumsum(sizes.sum(axis=1) + 3)])
    ids = np.empty(starts[-1], "<u4")
    text_at = starts[:-1] + sizes[:, 0] + 2
    text_end = text_at + sizes[:, 1]
    ids[starts[:-1]], ids[text_at - 1], ids[text_end] = start, middle, end
    body = np.ones(len(ids), bool)
    body[starts[:-1]] = body[text_at - 1] = body[text_end] = False
    ids[body] = np.frombuffer(b"".join(encoded), "<u4")
    change = np.zeros(len(ids) + 1, np.int64)
    trained = np.array([r == trained_role for r in roles], bool)
    np.add.at(change, text_at[trained], 1)
    np.add.at(change, text_end[trained], -1)
    mask = np.cumsum(change)[:-1].astype(np.uint8)
    packed, masked = ids.tobytes(), mask.tobytes()
    return ([packed[4 * a:4 * b] for a, b in zip(starts[:-1], starts[1:])],
            [masked[a:b] for a, b in zip(starts[:-1], starts[1:])])


def format_turns(turns: DataFrame, path: str, trained_role: str = "assistant", conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, ids, loss_mask) per row: packed ids with spliced marks, one mask byte a token.

    A conversation's tokens are its rows' tokens in the order of turns. Null texts and roles are
    empty. Other columns take no part. An empty table gives an empty result.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, masks = assembled(part.column("role").to_pylist(), part.column("text").to_pylist(),
                                       path, trained_role)
                yield pa.RecordBatch.from_pydict({
                    "conv_id": part.column("conv_id"), "turn": part.column("turn"),
                    "ids": pa.array(ids, pa.binary()), "loss_mask": pa.array(masks, pa.binary())})

    return rows.mapInArrow(run, "conv_id long, turn long, ids binary, loss_mask binary")


def parse_turn(ids: bytes, mask: bytes, path: str) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and the length of the rendering, from a turn's output."""
    words, (start, middle, end) = vocabulary(path), marks(path)
    values, chosen = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8).astype(bool)
    at = np.flatnonzero(values >= start)
    if len(at) != 3 or tuple(values[at]) != (start, middle, end) or at[0] != 0 or at[2] != len(values) - 1:
        raise ValueError("a turn's marks are not in place")
    role = words.decode(values[1:at[1]].tobytes())
    text = words.decode(values[at[1] + 1:at[2]].tobytes())
    trained = words.decode(values[chosen].tobytes()) if chosen.any() else ""
    return unescape(role), unescape(text), unescape(trained), len(role) + len(text) + sum(map(len, MARKS))


def render(ids: bytes, path: str) -> str:
    """The turn as text, content escaped."""
    words, reserved = vocabulary(path), marks(path)
    values = np.frombuffer(ids, "<u4")
    parts, before = [], 0
    for at in np.flatnonzero(values >= reserved[0]):
        parts += [words.decode(values[before:at].tobytes()), MARKS[values[at] - reserved[0]]]
        before = at + 1
    return "".join(parts)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Per conversation: n_turns, digests and lengths of its turns and of its trained text.

    Rows of a conversation are taken in the order of turn (null first), equal turns by their
    tokens. Digests run along the stream; rows with a null conversation form one.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state = [], None, None

        def close():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            columns = (batch.column(n) for n in ("conv_id", "ids", "loss_mask"))
            for conv, ids, mask in zip(*columns):
                conv = conv.as_py()
                if state is None or conv != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, trained, chars = parse_turn(ids.as_py(), mask.as_py(), path)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)],
                                                 schema=schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), schema.types)],
                                             schema=schema)

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))
