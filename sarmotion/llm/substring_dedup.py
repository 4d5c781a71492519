"""Repeated passages by fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words; their hashes are the index, and every rolling
window of BLOCK words of every document probes it. A passage of at least 2 * BLOCK words that occurs twice holds a
whole block in its first occurrence, so its second one has a probe that hits. Hits are extended to windows of
``2 * BLOCK`` words that hold them; windows are compared as a whole, the first occurrence stays, and overlapping
repeated windows join to maximal repeats.

Probes travel as packed arrays to buckets by hash. Within a task's piece of text equal probes or windows are folded
before they travel, so a passage that is everywhere costs each bucket one entry for each piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import (
    lean,
    PACKET, bucket_count, by_bucket, mix64, pack, packets, row_of, scattered, text_slices, total_text_bytes, unpack,
    window_hashes, word_hashes, written,
)
from sarmotion.llm.idfilter import thinned

BLOCK = 10
FLUSH_WORDS = 500_000

# Places (doc_id, word): ids of runs, run lengths, steps of up to 254 words, longer steps.
_PLACES = (np.int64, np.uint32, np.uint8, np.int64)
# Keys of probes with their places, keys that a piece holds repeatedly, and places known to be hits.
_PROBES = (np.uint32, *_PLACES, np.uint32, *_PLACES)
# Hashes and check hashes of windows with their places, and places known to be repeats.
_WINDOWS = (np.uint64, np.uint32, *_PLACES, *_PLACES)


def _coded(ids: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (words[1:] < words[:-1])]) if len(ids) else np.zeros(0, np.int64)
    step = np.diff(words, prepend=0)
    step[starts] = words[starts]
    return [
        ids[starts], np.diff(np.r_[starts, len(ids)]).astype(np.uint32),
        np.minimum(step, 255).astype(np.uint8), step[step >= 255].astype(np.int64),
    ]


def _decoded(ids: np.ndarray, lengths: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = small.astype(np.int64)
    step[small == 255] = large
    total = np.cumsum(step)
    starts = np.cumsum(lengths.astype(np.int64)) - lengths
    base = total[starts] - step[starts] if len(starts) else total
    return np.repeat(ids, lengths), total - np.repeat(base, lengths)


_NO_PLACES = _coded(np.zeros(0, np.int64), np.zeros(0, np.int64))


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(33)) % np.uint64(buckets)


class _Pieces:
    """Texts of several batches as word hashes, until there are enough for one exchange."""

    def __init__(self):
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, words: np.ndarray, first: np.ndarray) -> None:
        self.words.append(words)
        self.counts.append(np.diff(first))
        self.ids.append(ids)
        self.size += len(words)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words, each word's id, its place in its text, and how many words of the text begin with it."""
        words, counts, ids = (np.concatenate(x) for x in (self.words, self.counts, self.ids))
        first = np.concatenate([[0], np.cumsum(counts)])
        owner = row_of(first)
        place = np.arange(len(words)) - first[:-1][owner]
        self.__init__()
        return words, ids[owner], place, counts[owner] - place


def _slices_of(batch: pa.RecordBatch, pieces: _Pieces):
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    for row, end, data, offsets in text_slices(batch.column("text")):
        pieces.add(ids[row:end], *word_hashes(data, offsets, lower=False))
        if pieces.size >= FLUSH_WORDS:
            yield pieces.take()


def _probes(buckets: int, block: int):
    def sent(words, ids, place, left):
        at = np.flatnonzero(left >= block)
        if not len(at):
            return None
        h = window_hashes(words, block)[at]
        ids, place = ids[at], place[at]
        aligned = place % block == 0
        # The low 31 bits are the key, the rest names the bucket: a filter, later steps compare whole windows.
        bucket = (h >> np.uint64(31)) % np.uint64(buckets)
        key = h & np.uint64(0x7FFFFFFF)
        full = (bucket << np.uint64(31)) | key
        order = np.argsort(full, kind="stable")
        run = np.flatnonzero(np.r_[True, full[order][1:] != full[order][:-1]])
        size = np.diff(np.r_[run, len(order)])
        alone = np.zeros(len(order), dtype=bool)
        alone[order[run[size == 1]]] = True
        coded = ((key << np.uint64(1)) | aligned).astype(np.uint32)
        out = []
        for b, (k, i, p) in scattered(bucket[alone], buckets, coded[alone], ids[alone], place[alone]):
            out.append((b, pack(k, *_coded(i, p), np.zeros(0, np.uint32), *_NO_PLACES)))
        several = run[size > 1]
        any_aligned = np.logical_or.reduceat(aligned[order], run)[size > 1] if len(several) else np.zeros(0, bool)
        folded = ((key[order[several]] << np.uint64(1)) | any_aligned).astype(np.uint32)
        for b, (k,) in scattered(bucket[order[several]], buckets, folded):
            out.append((b, pack(np.zeros(0, np.uint32), *_NO_PLACES, k, *_NO_PLACES)))
        for b, (i, p) in scattered(_doc_bucket(ids[~alone], buckets), buckets, ids[~alone], place[~alone]):
            out.append((b, pack(np.zeros(0, np.uint32), *_NO_PLACES, np.zeros(0, np.uint32), *_coded(i, p))))
        return packets(out)

    def run(batches):
        pieces = _Pieces()
        for batch in batches:
            for piece in _slices_of(batch, pieces):
                found = sent(*piece)
                if found is not None:
                    yield found
        if pieces.size:
            found = sent(*pieces.take())
            if found is not None:
                yield found

    return lean(run)


def _to_documents(ids: list[np.ndarray], places: list[np.ndarray], buckets: int) -> pa.Table:
    ids, places = np.concatenate(ids), np.concatenate(places)
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    found = scattered(_doc_bucket(ids, buckets), buckets, ids, places)
    return pa.Table.from_batches([packets([(b, pack(*_coded(i, p))) for b, (i, p) in found])])


def _hits(buckets: int):
    """Probes that meet a block of another place, and blocks that meet another probe."""

    def run(payloads) -> pa.Table:
        keys, several, ids, places = [], [], [], []
        for payload in payloads:
            a = unpack(payload, *_PROBES)
            i, p = _decoded(*a[1:5])
            keys.append((a[0], i, p))
            several.append(a[5])
            i, p = _decoded(*a[6:10])
            ids.append(i)
            places.append(p)
        alone = np.concatenate([k for k, _, _ in keys])
        folded = np.concatenate(several)
        every = np.concatenate([alone, folded, folded]) >> np.uint32(1)
        values, place, count = np.unique(every, return_inverse=True, return_counts=True)
        blocks = np.zeros(len(values), dtype=np.int64)
        np.add.at(blocks, place[: len(alone) + len(folded)], np.concatenate([alone, folded]) & 1)
        own = place[: len(alone)]
        hit = np.where(alone & 1, count[own] >= 2, blocks[own] >= 1)
        ids.append(np.concatenate([i for _, i, _ in keys])[hit])
        places.append(np.concatenate([p for _, _, p in keys])[hit])
        return _to_documents(ids, places, buckets)

    return run


def _gathered(payloads) -> pa.Table:
    """One row for each document of a bucket with its places, ascending."""
    parts = [_decoded(*unpack(p, *_PLACES)) for p in payloads]
    ids, places = np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts])
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    fresh = np.r_[True, (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])] if len(ids) else np.zeros(0, bool)
    ids, places = ids[fresh], places[fresh]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    raw, edges = places.astype(np.uint32).tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
    return pa.table({
        "doc_id": pa.array(ids[starts]),
        "places": pa.array([raw[a:b] for a, b in zip(edges, edges[1:])], pa.binary()),
    })


def _row_places(column: pa.Array, first: np.ndarray, row: int, end: int, room: np.ndarray) -> np.ndarray:
    """Places of rows [row, end) as indexes into the piece's words; those beyond a text are left out."""
    out = []
    for i in range(row, end):
        p = np.frombuffer(column[i].as_buffer(), dtype=np.uint32).astype(np.int64)
        out.append(first[i - row] + p[p < room[i - row]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _windows(buckets: int, block: int):
    """Windows of two blocks that hold a hit, folded within a piece."""
    width = 2 * block

    def sent(waiting):
        h, check, ids, place = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((place, ids, check, h))
        h, check, ids, place = h[order], check[order], ids[order], place[order]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        each = np.repeat(start, np.diff(np.r_[start, len(h)]))
        later = (ids != ids[each]) | (place != place[each])
        first = np.zeros(len(h), dtype=bool)
        first[start] = True
        none = [np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
        by_place = np.flatnonzero(first)[np.lexsort((place[first], ids[first]))]
        out = [
            (b, pack(k, c, *_coded(i, p), *_NO_PLACES))
            for b, (k, c, i, p) in scattered(
                (h[by_place] >> np.uint64(32)) % np.uint64(buckets), buckets,
                h[by_place], check[by_place], ids[by_place], place[by_place],
            )
        ]
        by_place = np.flatnonzero(later)[np.lexsort((place[later], ids[later]))]
        for b, (i, p) in scattered(_doc_bucket(ids[by_place], buckets), buckets, ids[by_place], place[by_place]):
            out.append((b, pack(*none, *_NO_PLACES, *_coded(i, p))))
        return packets(out)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            places = batch.column("places")
            for row, end, data, offsets in text_slices(batch.column("text")):
                words, first = word_hashes(data, offsets, lower=False)
                counts = np.diff(first)
                hit = np.zeros(len(words) + 1, dtype=np.int32)
                hit[_row_places(places, first, row, end, counts)] = 1
                before = np.concatenate([[0], np.cumsum(hit)])
                owner = row_of(first)
                place = np.arange(len(words)) - first[:-1][owner]
                at = np.flatnonzero(counts[owner] - place >= width)
                at = at[before[at + block + 1] > before[at]]
                if len(at):
                    half = window_hashes(words, block)
                    h = mix64(half[at] * np.uint64(0x9FB21C651E98DF25) + half[at + block])
                    check = (mix64(half[at] ^ (half[at + block] * np.uint64(0xD1342543DE82EF95))) >> np.uint64(32)).astype(np.uint32)
                    waiting.append((h, check, all_ids[row:end][owner[at]], place[at]))
                    size += len(at)
                if size >= FLUSH_WORDS:
                    yield sent(waiting)
                    waiting, size = [], 0
        if size:
            yield sent(waiting)

    return lean(run)


def _repeats(buckets: int):
    """Places of windows whose words also start at an earlier place."""

    def run(payloads) -> pa.Table:
        parts, ids, places = [], [], []
        for payload in payloads:
            a = unpack(payload, *_WINDOWS)
            parts.append((a[0], a[1], *_decoded(*a[2:6])))
            i, p = _decoded(*a[6:10])
            ids.append(i)
            places.append(p)
        h, check, i, p = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((p, i, check, h))
        h, check, i, p = h[order], check[order], i[order], p[order]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.zeros(0, np.int64)
        each = np.repeat(start, np.diff(np.r_[start, len(h)]))
        later = (i != i[each]) | (p != p[each])
        return _to_documents([*ids, i[later]], [*places, p[later]], buckets)

    return run


def _whole(batches):
    """Words of a text, and the digest of all of them."""
    for batch in batches:
        counts, digests = [], []
        for text in batch.column("text"):
            raw = text.as_buffer()
            words = (raw.to_pybytes() if raw is not None else b"").split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "whole_sha256"],
        )


_RANGE = pa.struct([("word", pa.int64()), ("words", pa.int64())])


def _removed(width: int):
    """Maximal repeated ranges and the digest of what is left."""

    def run(batches):
        for batch in batches:
            removed, digests, ranges = [], [], []
            for text, raw in zip(batch.column("text"), batch.column("places")):
                words = (text.as_py() or "").encode().split()
                at = np.frombuffer(raw.as_buffer(), dtype=np.uint32).astype(np.int64)
                at = at[at + width <= len(words)]
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                ranges.append([{"word": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                removed.append(int(gone.sum()))
                kept = [words[i] for i in np.flatnonzero(~gone)]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(ranges, pa.list_(_RANGE))],
                names=["doc_id", "n_removed", "left_sha256", "ranges"],
            )

    return lean(run)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, ranges (removed words: first word, number of words).

    A word is removed if a window of ``2 * block`` consecutive words covers it whose sequence also starts earlier, in a
    document of a smaller doc_id or further up in the same. Windows are judged on the input. Null, empty and shorter
    texts lose nothing. Rows without a doc_id have no place in the order: they lose nothing and count as no
    occurrence. Rows that repeat a doc_id share places: a window at the same place is no repeat, and what one of
    them loses the others lose at the same words. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(spark, total_text_bytes(base))
    known = base.where("doc_id is not null and text is not null")
    found = "doc_id long, places binary"
    probes = known.mapInArrow(_probes(buckets, block), PACKET)
    hits = written(by_bucket(by_bucket(probes, _hits(buckets), PACKET), _gathered, found))
    texts = written(thinned(known, hits).join(hits, "doc_id"))
    windows = texts.mapInArrow(_windows(buckets, block), PACKET)
    repeats = by_bucket(by_bucket(windows, _repeats(buckets), PACKET), _gathered, found)
    cut = texts.select("doc_id", "text").join(repeats, "doc_id").mapInArrow(
        _removed(2 * block),
        "doc_id long, n_removed long, left_sha256 string, ranges array<struct<word:long,words:long>>",
    )
    whole = base.mapInArrow(lean(_whole), "doc_id long, n_words long, whole_sha256 string")
    return _attached(whole, cut)


def _attached(whole: DataFrame, cut: DataFrame) -> DataFrame:
    one = cut.groupBy("doc_id", F.col("n_removed"), "left_sha256", "ranges").agg(F.lit(1).alias("_")).drop("_")
    return whole.join(one, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("ranges", F.array().cast("array<struct<word:bigint,words:bigint>>")).alias("ranges"),
    )


def kept_texts(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the kept words of every text, joined by one space, from ``repeated_passages`` of the same rows."""

    def run(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                words = (text.as_py() or "").encode().split()
                for r in reversed(ranges or []):
                    del words[r["word"] : r["word"] + r["words"]]
                out.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = passages.where("n_removed > 0").select("doc_id", "ranges")
    return base.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, text string")
