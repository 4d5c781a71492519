"""Helpers of the text operators: shared tables, batches of bytes, word hashes, packed exchanges.

Texts move through numpy as one byte buffer and row offsets, in pieces of a few megabytes, so a task's
memory follows its longest single text and never its partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
RELEASE_BYTES = 16 << 20
BATCH_ROWS = 1000
BUCKET_BYTES = 64 << 20

# The white space of the word rules, [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[list(SPACES)] = False


# ---- memory of the Python workers ------------------------------------------------------------

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def _release() -> None:
    """Give freed memory back to the system: workers live on between tasks and would keep their peak."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(run):
    """``run`` over batches or over one group, with memory given back after RELEASE_BYTES of input and at the end."""

    def batchwise(batches):
        passed = 0
        for batch in batches:
            yield batch
            passed += batch.nbytes
            del batch
            if passed > RELEASE_BYTES:
                _release()
                passed = 0
        _release()

    def wrapped(data):
        if not isinstance(data, pa.Table):
            return run(batchwise(data))
        out = run(data)
        if data.nbytes > RELEASE_BYTES >> 4:
            del data
            _release()
        return out

    return wrapped


# ---- tables in the shared folder -------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a folder is made for a local master only; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sarmotion-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, free of its lineage, safe to reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python in batches of at most BATCH_ROWS, which bounds the buffers on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets that hold ``bucket_bytes`` at most on average, and at least one for each shuffle task."""
    return max(shuffle_partitions(spark), -(-int(total_bytes) // bucket_bytes), 1)


def total_text_bytes(docs: DataFrame, text: str = "text") -> int:
    found = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"]
    return int(found or 0)


def crc_mod(doc_id: Column | str, modulus: int) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


# ---- batches -----------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each piece of a column."""
    data, offsets = text_buffer(column)
    for row, end in slices(offsets, limit):
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]


# ---- hashing -----------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _weights(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix64((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E6C63D0876A9A47 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = {False: _weights(False), True: _weights(True)}
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _WORD_BYTE):
    """Starts and ends of every text's words in the buffer, and the first word of each row (n + 1 long)."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of every [start, end) of the buffer, from prefix sums of byte weights."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    terms = _WEIGHTS[lower][data] * _powers(_BASE, len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    found = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix64(found + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a piece, and where each row's words begin (n + 1 long)."""
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(data, starts, ends, lower), first


_STEP = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of words[i : i + n] for every i; windows may run over row ends, the caller masks them."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= _STEP
        out += words[k : len(words) - n + 1 + k]
    return mix64(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


# ---- exchanges of packed arrays ----------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind their byte lengths; the reader knows the types."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([a.nbytes for a in parts], dtype=np.int64)
    return b"".join([head.tobytes(), *[a.tobytes() for a in parts]])


def unpack(payload: bytes, *types) -> list[np.ndarray]:
    view = memoryview(payload)
    sizes = np.frombuffer(view[: 8 * len(types)], dtype=np.int64)
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes, types):
        out.append(np.frombuffer(view[at : at + int(size)], dtype=kind))
        at += int(size)
    return out


def gathered(payloads, *types) -> list[np.ndarray]:
    """The payloads' arrays, each kind joined over all payloads."""
    found = [unpack(p, *types) for p in payloads]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=t) for i, t in enumerate(types)]


def scattered(bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays dealt out by bucket; within a bucket the order stays."""
    small = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[order], np.arange(buckets + 1))
    taken = [a[order] for a in arrays]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), [a[edges[b] : edges[b + 1]] for a in taken]


PACKET = "bucket int, payload binary"


def packets(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())],
        names=["bucket", "payload"],
    )


def by_bucket(df: DataFrame, reduce: Callable[[list], pa.Table], schema: str) -> DataFrame:
    """Each bucket's packets in one call of ``reduce``; the number of buckets bounds what a call holds."""

    def run(part: pa.Table) -> pa.Table:
        return reduce([x for chunk in part.column("payload").chunks for x in (s.as_buffer() for s in chunk)])

    return df.groupBy("bucket").applyInArrow(lean(run), schema)

