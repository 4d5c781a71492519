"""Phase histories as Parquet, and an importer for a flat binary layout."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import FormatFault, UnsupportedFault
from ..operators.focus import Collect
from ..params import CollectMeta, Plane
from .binary import PULSE_ARROW, PULSE_SCHEMA, list_column, Span, spans
from .cphd import MAGIC as CPHD_MAGIC
from .cphd import read_cphd
from .stores import Location, Ranged, locate

# Fixed layout: magic, version, pulse and bin counts, then five scalars.
MAGIC = 0x52534348
VERSION = 2
HEADER = struct.Struct("<IIQQddddd")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.location = Location(options["path"], options.get("opener", ""))
        self.n_pulse, self.n_rbin = int(options["n_pulse"]), int(options["n_rbin"])

    def partitions(self):
        return spans(self.n_pulse, max(1, (32 << 20) // (self.n_rbin * 8)))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        n, count = self.n_pulse, partition.stop - partition.start
        base = HEADER.size
        with Ranged(self.location) as file:

            def doubles(column: int, width: int = 1) -> np.ndarray:
                return file.array("<f8", base + 8 * (column * n + width * partition.start), (width * count,))

            t, r_ref, position = doubles(0), doubles(1), doubles(2, 3).reshape(count, 3)
            pairs = file.array("<f4", base + 40 * n + 8 * self.n_rbin * partition.start, (count, self.n_rbin, 2))
        pulse = np.arange(partition.start, partition.stop, dtype=np.int64)
        columns = [pulse, t, *[np.ascontiguousarray(c) for c in position.T], r_ref]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns]
            + [list_column(pairs[:, :, 0]), list_column(pairs[:, :, 1])],
            schema=PULSE_ARROW,
        )


class FlatSource(DataSource):
    @classmethod
    def name(cls):
        return "sarmotion_flat"

    def schema(self):
        return PULSE_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_flat(spark: SparkSession, path: str) -> Collect:
    """Import a flat binary phase history; its range phase is absolute."""
    where = locate(spark, path)
    with Ranged(where) as file:
        size = file.size
        if size < HEADER.size:
            raise FormatFault(f"{path} is too short to hold a header")
        magic, version, n_pulse, n_rbin, near, dr, fc, lam, prf = HEADER.unpack(file.read(0, HEADER.size))
    if magic != MAGIC:
        raise FormatFault(f"{path} is not a phase-history file")
    if version != VERSION:
        raise UnsupportedFault(f"{path} has version {version}, not {VERSION}")
    if n_pulse == 0 or n_rbin == 0:
        raise FormatFault(f"an empty history of {n_pulse} pulses and {n_rbin} bins")
    if size < HEADER.size + n_pulse * (40 + 8 * n_rbin):
        raise FormatFault(f"{path} is truncated")
    spark.dataSource.register(FlatSource)
    pulses = (
        spark.read.format("sarmotion_flat").option("n_pulse", n_pulse).option("n_rbin", n_rbin)
        .option("opener", where.opener).load(path)
    )
    return Collect(pulses, CollectMeta(n_pulse, n_rbin, dr, fc, lam, prf, near, source="flat-file"))


def save(collect: Collect, path: str) -> None:
    """Pulses as Parquet with every scalar, phase reference and plane included."""
    collect.pulses.write.mode("overwrite").parquet(f"{path}/pulses")
    spark = collect.pulses.sparkSession
    row = [(json.dumps(asdict(collect.meta)),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_saved(spark: SparkSession, path: str) -> Collect:
    fields = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    plane = fields.pop("plane")
    if plane is not None:
        plane = Plane(**{k: tuple(v) if isinstance(v, list) else v for k, v in plane.items()})
    return Collect(spark.read.parquet(f"{path}/pulses"), CollectMeta(plane=plane, **fields))


def _is_saved(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a saved collect's metadata, in whatever store."""
    try:
        spark.read.text(f"{path}/meta").first()
    except (AnalysisException, Py4JJavaError):  # also a scheme that only the readers below know
        return False
    return True


def load_collect(
    spark: SparkSession, path: str, rbin_window: int = 0, pulse_stride: int = 1, max_pulses: int = 0
) -> Collect:
    """Open a collect by what it is: a saved one at any path that Spark reads, else a file by its first bytes."""
    if _is_saved(spark, path):
        return load_saved(spark, path)
    with Ranged(locate(spark, path)) as file:
        start = file.read(0, min(file.size, len(CPHD_MAGIC)))
    if start == CPHD_MAGIC:
        return read_cphd(spark, path, rbin_window, pulse_stride, max_pulses)
    return read_flat(spark, path)
