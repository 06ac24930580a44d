"""Bytes in zstd frames with a table of the frames behind them (the zstd seekable format).

A position is found through the table, so that a byte range is read by decompressing the frames it
meets and no others. Any zstd tool unpacks such a file: the table is a frame that it skips.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

SUFFIX = ".zst"
FRAME_BYTES = 64 * 1024
LEVEL = 1
TABLE, FOOT = 0x184D2A5E, 0x8F92EAB1
FOOT_BYTES = 9
END_BYTES = 16 * 1024  # read first; holds the table of some two thousand frames


def is_framed(name: str) -> bool:
    return name.endswith(SUFFIX)


class Writer:
    """Bytes to an open stream, in frames of ``frame_bytes`` each but the last."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.codec, self.held, self.sizes = pa.Codec("zstd", compression_level=level), bytearray(), []

    def write(self, data) -> None:
        self.held += data
        whole = len(self.held) - len(self.held) % self.frame_bytes
        for start in range(0, whole, self.frame_bytes):
            self._frame(bytes(self.held[start:start + self.frame_bytes]))
        del self.held[:whole]

    def _frame(self, data: bytes) -> None:
        packed = self.codec.compress(data, asbytes=True)
        self.stream.write(packed)
        self.sizes.append((len(packed), len(data)))

    def close(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
        entries = np.array(self.sizes, "<u4").reshape(-1, 2).tobytes()
        self.stream.write(struct.pack("<II", TABLE, len(entries) + FOOT_BYTES) + entries
                          + struct.pack("<IBI", len(self.sizes), 0, FOOT))
        self.stream.close()


class Reader:
    """The decompressed bytes of an open file of frames; holds the last frame read."""

    def __init__(self, file, name: str = ""):
        self.file, self.at, self.held = file, 0, (-1, b"")
        self.codec = pa.Codec("zstd")
        end = self._end(END_BYTES)
        frames, kind, magic = struct.unpack("<IBI", end[-FOOT_BYTES:]) if len(end) >= FOOT_BYTES else (0, 0, 0)
        if magic != FOOT:
            raise ValueError(f"no table of zstd frames at the end of {name}")
        entry = 12 if kind & 0x80 else 8  # with or without a checksum
        if len(end) < frames * entry + FOOT_BYTES:
            end = self._end(frames * entry + FOOT_BYTES)
        sizes = np.frombuffer(end[len(end) - FOOT_BYTES - frames * entry:len(end) - FOOT_BYTES], "<u4").reshape(frames, entry // 4)
        self.packed, self.plain = (np.r_[0, np.cumsum(sizes[:, i], dtype=np.int64)] for i in (0, 1))

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _end(self, most: int) -> bytes:
        size = self.file.size()
        self.file.seek(max(0, size - most))
        return self.file.read(min(size, most))

    def size(self) -> int:
        return int(self.plain[-1])

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        stop = min(self.at + n, self.size())
        if self.at >= stop:
            return b""
        first, last = int(np.searchsorted(self.plain, self.at, side="right")) - 1, int(np.searchsorted(self.plain, stop))
        parts = [self.held[1]] if self.held[0] == first else []
        start = first + len(parts)
        if start < last:
            self.file.seek(int(self.packed[start]))
            data = memoryview(self.file.read(int(self.packed[last] - self.packed[start])))
            for i in range(start, last):
                frame = data[self.packed[i] - self.packed[start]:self.packed[i + 1] - self.packed[start]]
                parts.append(self.codec.decompress(frame, int(self.plain[i + 1] - self.plain[i]), asbytes=True))
            self.held = last - 1, parts[-1]
        found = (parts[0] if len(parts) == 1 else b"".join(parts))[self.at - self.plain[first]:stop - self.plain[first]]
        self.at = stop
        return found
