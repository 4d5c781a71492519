"""Best-fit packing planned on the histogram of lengths.

Documents become token ids with an end id. Longer ones are cut into full pieces and a rest. The plan is best-fit
decreasing over counts: all pieces of one length are placed at once, into the fullest sequences that still take them,
and sequences with the same room are ranges, so the plan's size follows the number of lengths and not of documents.
A piece then takes the planned slot of its rank within its length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, text_slices, written

CAPACITY = 2048
END_ID = 0
CACHED_CHUNKS = 700_000
PIECE_BYTES = 1 << 22

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Python's split() also takes these four for white space; the tokenizer does not.
_NOT_SPACE = re.compile(rb"[\x1c-\x1f]")
_WORD_END = "</w>"
# Letters of one code point each in every normal form and case.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_SPLIT = re.compile(r"[^\S\x1c-\x1f]+")


class ChunkEncoder:
    """Ids of runs without white space, which the tokenizer drops and never joins across.

    Runs seen lately are kept in two generations of ``cached`` runs each, so memory is bounded and only time depends
    on what is kept.
    """

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = next(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        # Ids that end a word, where the vocabulary marks word ends.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.cached = cached
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Put every chunk into the young generation."""
        old = self.old
        young = self.young
        fresh = []
        for c in chunks:
            ids = old.get(c)
            if ids is None:
                fresh.append(c)
            else:
                young[c] = ids
        # Runs of plain letters are one word each: lists of them are parted where words end. Other runs are parted by
        # a token of its own, and runs that hold that token stand alone.
        words = [c for c in fresh if _LETTERS(c)] if self.ends.any() else []
        rest = set(fresh).difference(words)
        for c in [c for c in rest if self.mark in c]:
            rest.discard(c)
            young[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self._encode_lists(words, " ", lambda ids: np.flatnonzero(self.ends[ids]) + 1, 0)
        self._encode_lists(list(rest), self.mark, lambda ids: np.r_[np.flatnonzero(ids == self.mark_id), len(ids)], 1)

    def _encode_lists(self, chunks: list[str], between: str, edges_of, skip: int) -> None:
        """Encode lists of runs; ``edges_of`` tells where each run's ids end, ``skip`` ids lie between runs."""
        groups = [chunks[i : i + 256] for i in range(0, len(chunks), 256)]
        for at in range(0, len(groups), 32):
            some = groups[at : at + 32]
            found = self.tokenizer.encode_batch_fast([between.join(g) for g in some], add_special_tokens=False)
            for group, encoding in zip(some, found):
                ids = np.array(encoding.ids, dtype="<u4")
                raw, ends = ids.tobytes(), edges_of(ids)
                if len(ends) != len(group):
                    raise ValueError("the tokenizer joins or parts runs in an unknown way")
                starts = np.r_[0, ends[:-1] + skip] * 4
                self.young.update(zip(group, map(raw.__getitem__, map(slice, starts.tolist(), (ends * 4).tolist()))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each row of a piece, without special tokens and without an end id."""
        raw = data.tobytes()
        if b"<" not in raw:  # no special token can be spelled, and case does not matter to the others
            raw = raw.translate(_LOWER)
        if _NOT_SPACE.search(raw):
            split = lambda t: [c for c in _SPLIT.split(t) if c]
        else:
            split = str.split
        edges = offsets.tolist()
        lists = [split(raw[a:b].decode()) for a, b in zip(edges, edges[1:])]
        wanted = set().union(*lists) if lists else set()
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        self.learn(wanted.difference(self.young))
        get = self.young.__getitem__
        return [b"".join(map(get, chunks)) for chunks in lists]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, cached: int = CACHED_CHUNKS) -> ChunkEncoder:
    """One for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].cached = cached
    return _ENCODERS[path]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each full stop or comma that stands between a letter a-z and white space.

    Such a mark is a piece of its own to the tokenizer, so the ids stay, and there are fewer different runs.
    """
    if not len(data):
        return data, offsets
    last = np.zeros(len(data), dtype=bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    following = np.r_[data[1:], 32]
    mark = ((data == 46) | (data == 44)) & (last | (following == 32) | (following == 10))
    before = np.r_[np.uint8(0), data[:-1]] | 32
    mark &= (before >= 97) & (before <= 122)
    mark[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(mark)
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long, ids binary"


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, cached: int):
    tail = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids_in = batch.column("doc_id").to_pylist()
            for row, end, data, offsets in text_slices(batch.column("text"), PIECE_BYTES):
                out: list[tuple] = []
                for doc_id, ids in zip(ids_in[row:end], encoder(path, cached).encode(*spaced(data, offsets))):
                    ids += tail
                    for piece, at in enumerate(range(0, len(ids), width)):
                        own = ids[at : at + width]
                        n = len(own) // 4
                        out.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, int(ranks[n]), own if with_ids else None))
                        ranks[n] += 1
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return lean(run)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, items, first sequence, items per sequence, offset) of best-fit decreasing.

    A range of sequences with equal room halves its room at least each time it is used, so there are at most
    log2(capacity) runs for each range ever made, and three ranges for each length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, sequences)
    sizes: list[int] = []  # rooms in use, ascending
    runs: list[tuple] = []
    made = 0

    def put(size: int, first: int, count: int) -> None:
        if size > 0 and count > 0:
            if size not in room:
                room[size] = []
                bisect.insort(sizes, size)
            room[size].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, count = room[size].pop()
                if not room[size]:
                    del room[size]
                    sizes.pop(at)
            else:
                size = capacity
                first, count = made, -(-left // (capacity // length))
                made += count
            each = size // length
            full = min(count, left // each)
            over = min(left - full * each, each - 1) if full < count else 0
            used = full * each + over
            runs.append((length, rank, used, first, each, capacity - size))
            put(size - each * length, first, full)
            if over:
                put(size - over * length, first + full, 1)
            touched = full + (over > 0)
            put(size, first + touched, count - touched)
            rank, left = rank + used, left - used
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def _slots(plan: np.ndarray):
    """Sequence and offset of each (length, rank)."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(plan[:, 0], length), np.searchsorted(plan[:, 0], length, side="right")
            while True:  # the last run of the length that begins at or before the rank
                wide = high - low > 1
                if not wide.any():
                    break
                middle = (low + high) // 2
                right = wide & (plan[np.minimum(middle, len(plan) - 1), 1] <= rank)
                low = np.where(right, middle, low)
                high = np.where(wide & ~right, middle, high)
            own = plan[low]
            along = rank - own[:, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch(
                [*[batch.column(c) for c in keep], pa.array(own[:, 3] + along // own[:, 4]),
                 pa.array(own[:, 5] + along % own[:, 4] * length)],
                names=[*keep, "sequence_id", "offset"],
            )

    return lean(run)


def packed_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cached_chunks: int = CACHED_CHUNKS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    ``cached_chunks`` bounds the memory of a worker (about 250 bytes for each, twice) and changes no result.
    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. A null or empty text is a document of
    the end id alone. Rows that repeat a doc_id are packed one by one; a null doc_id is carried. Other columns are not
    read. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = base.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids, cached_chunks), PIECES)
    pieces = written(pieces if with_ids else pieces.drop("ids"))
    # Ranks within a length: those before in earlier parts, then the rank in the own part. No length is gathered.
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("local_rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} {dict(ranked.dtypes)[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_slots(best_fit_plan(histogram, capacity)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pieces with ids; a sequence has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
