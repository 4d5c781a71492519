"""Flat float32 cubes, written by the tasks that hold their samples.

A cube is runs of equal length, numbered in plane, row, column order.  On a file system that all executors mount it is
one flat file: every task writes its own byte ranges of a partial file, which gets its name when the job commits.  In any
other store it is a folder: every task writes one part of consecutive runs, and the manifest that the commit adds says
where each stretch of runs lies.  Either way a text header goes beside it last, nothing is seen before the commit, and a
failed job leaves nothing.  A task may run twice: it writes the same bytes again, or a part that no manifest names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import ArgumentError, FormatFault, IoFault
from ..sources.stores import Location, Ranged, locate, read_all

RUN_SCHEMA = "at bigint, run array<float>"
MANIFEST = "manifest.json"
READ_BYTES = 16 << 20


@dataclass(frozen=True)
class Cube:
    n_plane: int
    n_row: int
    n_col: int
    run: int
    axes: str = ""

    @property
    def runs(self) -> int:
        return self.n_plane * self.n_row * self.n_col // self.run

    def header(self) -> bytes:
        lines = [
            "format float32", "byte_order little_endian", f"n_plane {self.n_plane}", f"n_row {self.n_row}",
            f"n_col {self.n_col}", "layout plane-major, then row, then column",
        ]
        return "".join(f"{x}\n" for x in lines + ([f"axes {self.axes}"] if self.axes else [])).encode()


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as out:
        out.write(data)


@dataclass
class _Written(WriterCommitMessage):
    """One task's part (empty for a flat file) and its stretches of consecutive runs, in file order."""

    part: str
    stretches: list[tuple[int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.location = Location(options["target"], options.get("opener", ""))
        self.cube = Cube(**json.loads(options["cube"]))
        self.flat = options["form"] == "flat"
        self.mark = uuid.uuid4().hex

    def _batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in iterator:
            at, runs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            if batch.num_rows and (batch.column(0).null_count or at.min() < 0 or at.max() >= self.cube.runs):
                raise ArgumentError(f"a run lies outside the {self.cube.runs} of the cube")
            values = runs.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            if len(values) != len(at) * self.cube.run:
                raise ArgumentError(f"a run has another length than {self.cube.run}")
            yield at, values.reshape(len(at), self.cube.run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self._ranges(iterator) if self.flat else self._part(iterator)

    @property
    def _partial(self) -> str:
        return f"{self.location.file_system()[1]}.{self.mark}.partial"

    def _ranges(self, iterator) -> _Written:
        size = 4 * self.cube.run
        handle = os.open(self._partial, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for at, values in self._batches(iterator):
                for edge in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(edge):
                        data, place = memoryview(values[edge].tobytes()), int(at[edge[0]]) * size
                        while data:
                            done = os.pwrite(handle, data, place)
                            data, place = data[done:], place + done
        finally:
            os.close(handle)
        return _Written("", [])

    def _part(self, iterator) -> _Written:
        system, root = self.location.file_system()
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.f32"
        folder, stretches = f"{root}/_partial-{self.mark}", []
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for at, values in self._batches(iterator):
                out.write(values.tobytes())
                for edge in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    if not len(edge):
                        continue
                    if stretches and sum(stretches[-1]) == edge[0]:
                        stretches[-1] = (stretches[-1][0], stretches[-1][1] + len(edge))
                    else:
                        stretches.append((int(edge[0]), len(edge)))
        return _Written(name, stretches)

    def commit(self, messages) -> None:
        system, root = self.location.file_system()
        try:
            if self.flat:
                # Tasks without rows may have left the file short, or not made it at all.
                with open(self._partial, "ab") as f:
                    f.truncate(4 * self.cube.run * self.cube.runs)
                os.replace(self._partial, root)
                _put(system, f"{root}.hdr", self.cube.header())
                return
            parts = sorted((m for m in messages if m is not None and m.stretches), key=lambda m: m.stretches[0])
            system.create_dir(root, recursive=True)
            for m in parts:
                system.move(f"{root}/_partial-{self.mark}/{m.part}", f"{root}/{self.mark}-{m.part}")
            self._discard()
            _put(system, f"{root}/cube.hdr", self.cube.header())
            listed = [{"part": f"{self.mark}-{m.part}", "stretches": m.stretches} for m in parts]
            _put(system, f"{root}/{MANIFEST}", json.dumps({"run": self.cube.run, "runs": self.cube.runs, "parts": listed}).encode())
        except OSError as error:
            raise IoFault(f"cannot write {self.location}: {error}") from error

    def _discard(self) -> None:
        system, root = self.location.file_system()
        if self.flat:
            if os.path.exists(self._partial):
                os.unlink(self._partial)
            return
        folder = f"{root}/_partial-{self.mark}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)

    def abort(self, messages) -> None:
        self._discard()


@dataclass
class _Stretch(InputPartition):
    """Runs ``[at, at + count)`` at a byte offset of a file."""

    path: str
    offset: int
    at: int
    count: int

    def __init__(self, path: str, offset: int, at: int, count: int):
        self.path, self.offset, self.at, self.count = path, offset, at, count


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.location = Location(options["target"], options.get("opener", ""))
        self.run, self.runs, self.flat = int(options["run"]), int(options["runs"]), options["form"] == "flat"

    def partitions(self):
        size = 4 * self.run
        step = max(1, READ_BYTES // size)
        if self.flat:
            return [_Stretch(self.location.path, size * s, s, min(step, self.runs - s)) for s in range(0, self.runs, step)]
        found = []
        for part in json.loads(read_all(Location(f"{self.location}/{MANIFEST}", self.location.opener)))["parts"]:
            offset = 0
            for at, count in part["stretches"]:
                for s in range(0, count, step):
                    found.append(_Stretch(f"{self.location}/{part['part']}", offset + size * s, at + s, min(step, count - s)))
                offset += size * count
        return found

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        with Ranged(Location(partition.path, self.location.opener)) as file:
            values = file.array("<f4", partition.offset, (partition.count * self.run,))
        offsets = np.arange(0, len(values) + 1, self.run, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(partition.at, partition.at + partition.count)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            names=["at", "run"],
        )


class CubeSource(DataSource):
    """Runs ``(at, run)`` of a flat cube."""

    @classmethod
    def name(cls):
        return "sarmotion_cube"

    def schema(self):
        return RUN_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def _is_mounted(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def export_cube(
    rows: DataFrame, index: str, values: str, n_plane: int, n_row: int, n_col: int, path: str, axes: str = ""
) -> None:
    """Runs ``values`` numbered by ``index`` as one flat cube; runs that no row gives are zero.

    A path without a scheme (or with ``file://``) must be mounted by every executor and becomes one file with
    ``<path>.hdr``; any other becomes a folder of parts with a manifest.  A cube that is there is replaced.
    """
    if min(n_plane, n_row, n_col) <= 0:
        raise ArgumentError("cube dimensions must be positive")
    spark = rows.sparkSession
    runs = rows.select(F.col(index).cast("bigint").alias("at"), F.transform(values, lambda x: x.cast("float")).alias("run"))
    first = runs.first()
    run = len(first["run"]) if first is not None else n_col
    if run == 0 or n_plane * n_row * n_col % run:
        raise ArgumentError(f"runs of {run} samples do not make a cube of {n_plane} x {n_row} x {n_col}")
    cube = {"n_plane": n_plane, "n_row": n_row, "n_col": n_col, "run": run, "axes": axes}
    spark.dataSource.register(CubeSource)
    where = locate(spark, path)
    (
        runs.repartitionByRange("at").sortWithinPartitions("at").write.format("sarmotion_cube").mode("append")
        .option("target", where.path).option("opener", where.opener).option("cube", json.dumps(cube))
        .option("form", "flat" if _is_mounted(path) and not where.opener else "parts").save()
    )


def read_cube(spark: SparkSession, path: str, run: int = 0) -> DataFrame:
    """The runs of an exported cube; those of a flat file have ``run`` samples, its row length by default."""
    where = locate(spark, path)
    flat = _is_mounted(path) and not where.opener
    if flat:
        fields = dict(x.split(" ", 1) for x in read_all(f"{path}.hdr").decode().splitlines())
        shape = [int(fields[k]) for k in ("n_plane", "n_row", "n_col")]
        run = run or shape[2]
        total = int(np.prod(shape))
        if total % run:
            raise FormatFault(f"{path} does not hold whole runs of {run} samples")
        runs = total // run
    else:
        listed = json.loads(read_all(Location(f"{path}/{MANIFEST}", where.opener)))
        run, runs = listed["run"], listed["runs"]
    spark.dataSource.register(CubeSource)
    return (
        spark.read.format("sarmotion_cube").option("target", where.path).option("opener", where.opener)
        .option("run", run).option("runs", runs).option("form", "flat" if flat else "parts").load()
    )
