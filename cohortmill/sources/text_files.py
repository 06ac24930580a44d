"""Many small text files written by the tasks that hold their lines.

Spark's own writers make a folder and a checksum per value, commit them on the driver, and send it
each folder's name; a hundred thousand small files cost more there than their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortmill.sources import framed
from cohortmill.sources.byte_files import file_system


class Writer:
    """Lines to files below ``path``, a file at a time, each with a header. A file has a hidden name until
    it is whole, so that a task that runs again, or twice, leaves it once."""

    def __init__(self, path: str, name: str, header: str, attempt: int):
        self.system, self.root = file_system(path)
        self.name, self.header, self.attempt = name, header, attempt
        self.place, self.file, self.folders = None, None, set()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, failed, *_) -> None:
        if failed is None:
            self._finish()
        elif self.file:
            self.file.close()

    def add(self, places: pa.Array, lines: pa.Array) -> None:
        """Lines, each with its line end, of files in order: equal places are neighbours."""
        runs, start = pc.run_end_encode(places), 0
        _, offsets, data = lines.cast(pa.string()).buffers()  # without nulls the lines of a file are one piece of it
        offsets = np.frombuffer(offsets, np.int32)[lines.offset:]
        for place, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if place != self.place:
                self._finish()
                self._begin(place)
            self.file.write(memoryview(data)[offsets[start]:offsets[end]])
            start = end

    def _begin(self, place: str) -> None:
        folder, _, self.stem = f"{self.root.rstrip('/')}/{place}".rpartition("/")
        if folder not in self.folders:
            self.system.create_dir(folder, recursive=True)
            self.folders.add(folder)
        self.place, self.folder = place, folder
        self.file = self.system.open_output_stream(self._hidden(), compression=None)
        self.file.write(f"{self.header}\n".encode())

    def _finish(self) -> None:
        if self.file:
            self.file.close()
            self.system.move(self._hidden(), f"{self.folder}/{self.stem}.{self.name}")
            self.file = None

    def _hidden(self) -> str:
        return f"{self.folder}/.{self.stem}.{self.attempt}.{self.name}"


class ArrayWriter:
    """JSON texts to array files below ``path``, ``rows`` to each, in zstd frames with ``opening`` and
    ``closing`` around the elements. Names are hidden until a file is whole, as those of ``Writer``."""

    BETWEEN = ",\n"

    def __init__(self, path: str, name: str, opening: str, closing: str, rows: int, attempt: int):
        self.system, self.root = file_system(path)
        self.name, self.opening, self.closing, self.rows, self.attempt = name, opening, closing, rows, attempt
        self.number, self.left, self.file = 0, 0, None

    def __enter__(self) -> ArrayWriter:
        self.system.create_dir(self.root, recursive=True)
        return self

    def __exit__(self, failed, *_) -> None:
        if failed is None:
            self._finish()
        elif self.file:
            self.file.stream.close()

    def add(self, texts: pa.Array) -> None:
        """Texts that begin with ``BETWEEN`` each."""
        texts, start = texts.cast(pa.string()).drop_null(), 0
        _, offsets, data = texts.buffers()
        place = np.frombuffer(offsets, np.int32)[texts.offset:] if len(texts) else None
        while start < len(texts):
            skipped = 0 if self.file else len(self.BETWEEN)
            if not self.file:
                self.file, self.left = framed.Writer(self.system.open_output_stream(self._name(hidden=True), compression=None)), self.rows
                self.file.write(self.opening.encode())
            end = min(start + self.left, len(texts))
            self.file.write(memoryview(data)[place[start] + skipped:place[end]])
            self.left -= end - start
            start = end
            if not self.left:
                self._finish()

    def _finish(self) -> None:
        if self.file:
            self.file.write(self.closing.encode())
            self.file.close()
            self.system.move(self._name(hidden=True), self._name())
            self.file, self.number = None, self.number + 1

    def _name(self, hidden: bool = False) -> str:
        name = f"{self.name}-{self.number:05d}.json{framed.SUFFIX}"
        return f"{self.root.rstrip('/')}/" + (f".{self.attempt}.{name}" if hidden else name)
