"""Files wherever they are: ranged reads through Arrow file systems, alike on the driver and in tasks.

A plain path is a local file; anything with a scheme goes to the Arrow file system of that scheme.  A scheme that Arrow
does not know is opened by a function that the session names in ``spark.sarmotion.store.<scheme>`` as ``module:function``;
it takes no argument and returns a ``pyarrow.fs.FileSystem``.
"""

from __future__ import annotations

import importlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from ..errors import FormatFault, IoFault

OPENERS = "spark.sarmotion.store."
# Rows of a file that lie closer than this are fetched by one request.
NEAR = 1 << 16


@dataclass(frozen=True)
class Location:
    """A path and, where its scheme needs one, the function that opens its store."""

    path: str
    opener: str = ""

    def __str__(self) -> str:
        return self.path

    def file_system(self) -> tuple[fs.FileSystem, str]:
        scheme, found, rest = self.path.partition("://")
        if self.opener:
            module, _, name = self.opener.partition(":")
            return getattr(importlib.import_module(module), name)(), rest
        if found or scheme.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), os.path.abspath(self.path)


def locate(spark: SparkSession, path: str) -> Location:
    scheme, found, _ = path.partition("://")
    return Location(path, spark.conf.get(OPENERS + scheme, "") if found else "")


def located(path: str | Location) -> Location:
    return path if isinstance(path, Location) else Location(path)


class Ranged:
    """One open file; every read names its range."""

    def __init__(self, path: str | Location):
        self.location = located(path)
        try:
            system, inner = self.location.file_system()
            self._file = system.open_input_file(inner)
            self.size = self._file.size()
        except (OSError, pa.ArrowException, ImportError, AttributeError) as error:
            raise IoFault(f"cannot open {path}: {error}") from error

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def read(self, offset: int, length: int) -> bytes:
        """Exactly ``length`` bytes, or a refusal."""
        try:
            data = self._file.read_at(length, offset)
        except (OSError, pa.ArrowException) as error:
            raise IoFault(f"cannot read {self.location}: {error}") from error
        if len(data) != length:
            raise FormatFault(f"{self.location} is shorter than its header says: it ends at byte {offset + len(data)}")
        return data

    def array(self, kind: str, offset: int, shape: tuple[int, ...]) -> np.ndarray:
        count = int(np.prod(shape, dtype=np.int64))
        return np.frombuffer(self.read(offset, count * np.dtype(kind).itemsize), kind).reshape(shape)

    def rows(self, kind: str, offset: int, width: int, rows: np.ndarray) -> np.ndarray:
        """The given rows (ascending) of a matrix of ``width`` items a row; neighbours share a request."""
        size = width * np.dtype(kind).itemsize
        out = np.empty((len(rows), width), kind)
        gap = np.flatnonzero((np.diff(rows) - 1) * size > NEAR) + 1
        for part in np.split(np.arange(len(rows)), gap):
            if len(part):
                first, last = int(rows[part[0]]), int(rows[part[-1]])
                found = self.array(kind, offset + first * size, (last - first + 1, width))
                out[part] = found[rows[part] - first]
        return out

    def window(self, kind: str, offset: int, width: int, rows: np.ndarray, columns: list[tuple[int, int]]) -> np.ndarray:
        """Column ranges of rows, side by side; of wide rows only the ranges are fetched."""
        item = np.dtype(kind).itemsize
        if 2 * sum(b - a for a, b in columns) * item + NEAR > width * item:
            whole = self.rows(kind, offset, width, rows)
            return np.concatenate([whole[:, a:b] for a, b in columns], axis=1)
        return np.stack([
            np.concatenate([self.array(kind, offset + (int(r) * width + a) * item, (b - a,)) for a, b in columns]) for r in rows
        ]) if len(rows) else np.empty((0, sum(b - a for a, b in columns)), kind)


def read_all(path: str | Location) -> bytes:
    with Ranged(path) as file:
        return file.read(0, file.size)
