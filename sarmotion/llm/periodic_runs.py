"""Periodic runs of words: maximal stretches that repeat a period at least three times.

Periods are taken by octaves. Each octave explodes a text into overlapping tiles, one round each boundary, spaced so that a
run of any of its periods crosses at least one boundary. A tile is solved by itself: the Z-functions of its boundary
(how far the words from the boundary on, and those before it, equal the words one period later) give every
period's stretch at once, cut at the tile's edges. The values start with two look-ups, which weed out nearly all periods;
the others are found by bisection over prefix hashes. What is left are intervals (row, period, from, to). They are shuffled
by row and period, where those that touch are stitched; whole runs go back to the rows that have any.

The text itself is never exploded: its tiles are views inside the task that read it. Only rows with an interval write
their words, and only they are joined again.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarmotion.llm.common import (
    _BASE, _INVERSE, _powers, lean, mix64, span_hashes, text_slices, word_bounds, written,
)

LEAST_WORDS = 24
LEAST_PERIODS = 3
# A run's equal places (its length less one period) are never fewer than this.
ANCHOR = 16
PAIRS = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def least_equal(period: np.ndarray) -> np.ndarray:
    """Places i with word i equal to word i + period that a run has at least."""
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period


class PrefixHashes:
    """Hashes of any stretch of a sequence, from prefix sums modulo 2^64."""

    def __init__(self, items: np.ndarray):
        self.inverse = _powers(_INVERSE, len(items) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(items) * _powers(_BASE, len(items)), dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.of(a, length) == self.of(b, length)


def _z_values(hashes: PrefixHashes, at: np.ndarray, period: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
    """The tile's Z-function at each period: equal words from ``at`` on (or before it), at most ``most``."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        start = at if ahead else at - middle
        good = hashes.same(start, start + period, middle)
        low = np.where(open_ & good, middle, low)
        high = np.where(open_ & ~good, middle - 1, high)


def _primes_of(period: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, prime divisor) of every period, one prime a step."""
    out, rest, prime = [], period.copy(), 2
    while len(rest) and prime * prime <= rest.max():
        found = np.flatnonzero(rest % prime == 0)
        if len(found):
            out.append((found, np.full(len(found), prime, dtype=period.dtype)))
            while len(found):
                rest[found] //= prime
                found = found[rest[found] % prime == 0]
        prime += 1 if prime == 2 else 2
    left = np.flatnonzero(rest > 1)
    out.append((left, rest[left]))
    return out


def _primitive(hashes: PrefixHashes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the words of one period are no repetition of a shorter block, so that no divisor is a period too."""
    good = np.ones(len(start), dtype=bool)
    for place, prime in _primes_of(period):
        part = period[place] // prime
        good[place] &= ~hashes.same(start[place], start[place] + part, period[place] - part)
    return good


def _octaves(longest: int):
    """(first period, end, spacing of the boundaries); the first octaves share the smallest spacing."""
    low, high = 1, ANCHOR
    while low * LEAST_PERIODS <= longest:
        yield low, high, max(high, ANCHOR)
        low, high = high, 2 * high


def tile_intervals(items: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, period, from, to) of all tiles of the rows' items; ``from`` and ``to`` count from the row's first item.

    An interval holds the places whose item equals the one a period later, as far as one tile shows them.
    """
    counts = np.diff(first)
    found: list[list[np.ndarray]] = [[], [], [], []]
    longest = int(counts.max(initial=0))
    if longest < LEAST_WORDS:
        return tuple(np.zeros(0, dtype=np.int64) for _ in found)
    hashes = PrefixHashes(items)
    anchor = ANCHOR // 2
    anchors = hashes.of(np.arange(max(len(items) - anchor + 1, 0)), anchor)
    for low, high, spacing in _octaves(longest):
        rows = np.flatnonzero(counts >= max(LEAST_WORDS, LEAST_PERIODS * low))
        begin = -(-first[rows] // spacing)
        number = np.maximum(-(-first[rows + 1] // spacing) - begin, 0)
        row_of_tile = np.repeat(rows, number)
        boundary = (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(begin, number)) * spacing
        periods = np.arange(low, high)
        step = max(1, PAIRS // len(periods))
        for k in range(0, len(boundary), step):
            own, at = row_of_tile[k : k + step], boundary[k : k + step]
            end = first[own + 1]
            later = at[:, None] + periods[None, :]
            equal = items[np.minimum(later, len(items) - 1)] == items[at][:, None]
            equal &= (later < end[:, None]) & (LEAST_PERIODS * periods[None, :] <= counts[own][:, None])
            tile, which = np.nonzero(equal)
            if not len(tile):
                continue
            b, p, begin_of, end_of = at[tile], periods[which], first[own[tile]], end[tile]
            right_room, left_room = end_of - p - b, b - begin_of
            last = max(len(anchors) - 1, 0)
            ahead = (right_room >= anchor) & (anchors[np.minimum(b, last)] == anchors[np.minimum(b + p, last)])
            back = (left_room >= anchor) & (anchors[np.clip(b - anchor, 0, last)] == anchors[np.clip(b - anchor + p, 0, last)])
            kept = ahead | back
            b, p, right_room, left_room, tile = b[kept], p[kept], right_room[kept], left_room[kept], tile[kept]
            right = _z_values(hashes, b, p, np.minimum(right_room, spacing), ahead=True)
            left = _z_values(hashes, b, p, np.minimum(left_room, spacing), ahead=False)
            kept = (right >= spacing) | (left >= spacing) | (left + right >= least_equal(p))
            kept[kept] = _primitive(hashes, b[kept] - left[kept], p[kept])
            base = first[own[tile[kept]]]
            for part, values in zip(found, (own[tile[kept]], p[kept], b[kept] - left[kept] - base, b[kept] + right[kept] - base)):
                part.append(values.astype(np.int64))
    return tuple(np.concatenate(part) if part else np.zeros(0, dtype=np.int64) for part in found)


def joined(row: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one row and period that overlap or touch, as one (the map side of the stitching)."""
    order = np.lexsort((low, period, row))
    row, period, low, high = row[order], period[order], low[order], high[order]
    if not len(row):
        return row, period, low, high
    fresh = np.r_[True, (row[1:] != row[:-1]) | (period[1:] != period[:-1])]
    group = np.cumsum(fresh) - 1
    # Each group is lifted above the one before it, so one running maximum serves all.
    lift = group * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + lift)
    fresh[1:] |= low[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return row[at], period[at], low[at], np.maximum.reduceat(high, at)


def planted_places(key: str | None, n: int) -> np.ndarray | None:
    """The word taken for each place where the crc32 of ``key`` asks for a planted period; None where it does not."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_TILED = "row long, doc_id long, whole string, words binary, found array<struct<period:long,low:long,high:long>>"
_FOUND = pa.list_(pa.struct([("period", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))


def _tiled(planted: bool):
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for row, end, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = word_bounds(data, offsets)
                items = span_hashes(data, starts, ends, lower=False)
                raw = data.tobytes()
                place = {}
                if planted:
                    for i in range(end - row):
                        taken = planted_places(keys[row + i], int(first[i + 1] - first[i]))
                        if taken is not None:
                            place[i] = taken
                            items[first[i] : first[i + 1]] = items[first[i] : first[i + 1]][taken]
                own, period, low, high = joined(*tile_intervals(items, first))
                edge = np.searchsorted(own, np.arange(end - row + 1))
                whole, words, found = [], [], []
                for i in range(end - row):
                    text = raw[offsets[i] : offsets[i + 1]].split()
                    if i in place:
                        text = [text[j] for j in place[i]]
                    a, b = edge[i], edge[i + 1]
                    whole.append(None if b > a else _digest(text))
                    words.append(b" ".join(text) if b > a else None)
                    found.append([{"period": p, "low": l, "high": h} for p, l, h in zip(period[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist())])
                yield pa.record_batch(
                    [batch.column("row").slice(row, end - row), batch.column("doc_id").slice(row, end - row),
                     pa.array(whole, pa.string()), pa.array(words, pa.binary()), pa.array(found, _FOUND)],
                    names=["row", "doc_id", "whole", "words", "found"],
                )

    return lean(run)


def stitched(intervals: DataFrame) -> DataFrame:
    """Runs (row, period, start, length) from the tiles' intervals, shuffled by row and period."""
    ordered = Window.partitionBy("row", "period").orderBy("low", "high")
    before = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = intervals.withColumn("fresh", F.coalesce((F.col("low") > before).cast("long"), F.lit(1)))
    numbered = apart.withColumn("island", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    length = F.col("high") - F.col("start") + F.col("period")
    least = F.greatest(F.lit(LEAST_WORDS), F.lit(LEAST_PERIODS) * F.col("period"))
    return whole.select("row", "period", "start", length.alias("length")).where(F.col("length") >= least)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period) the one with the greatest exact exponent; ties go to the smallest start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def _collapsed(batches):
    for batch in batches:
        out = []
        for doc_id, whole, words, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "whole", "words", "runs"))):
            runs = sorted(((r["start"], r["length"], r["period"]) for r in runs or []), key=lambda r: (r[0], r[2]))
            best = strongest(runs)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            if whole is None:
                text = words.split(b" ")
                gone = np.zeros(len(text) + 1, dtype=np.int64)
                for s, n, p in runs:
                    gone[s + p] += 1
                    gone[s + n] -= 1
                whole = _digest([w for w, g in zip(text, np.cumsum(gone[:-1]).tolist()) if not g])
            out.append(
                {"doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1],
                 "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
                 "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": whole}
            )
        schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _RESULT.split(", ")])
        yield pa.RecordBatch.from_pylist(out, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: its runs in number and digest, the strongest one, and the text without repeats.

    ``planted`` is a string key for each row: where its crc32 is divisible by ten, the end of the text is replaced by a
    repeated period that the crc32 fixes (a test load); without it texts stay as they are. Null and empty texts and those
    below 24 words have no run: four nulls and the digest of their words. Rows are told apart by a number of their own, so
    repeated and null doc_ids keep a row each. Only the named columns are read; an empty table gives an empty result.
    """
    key = F.lit(None).cast("string") if planted is None else planted
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    tiled = written(numbered.mapInArrow(_tiled(planted is not None), _TILED))
    with_found = tiled.where("whole is null")
    intervals = with_found.select("row", F.inline("found"))
    runs = stitched(intervals).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    none = tiled.where("whole is not null").select("doc_id", "whole", F.lit(None).cast("binary").alias("words"), F.expr(
        "cast(null as array<struct<start:long,length:long,period:long>>)").alias("runs"))
    some = with_found.join(runs, "row", "left").select("doc_id", "whole", "words", "runs")
    return none.unionByName(some).mapInArrow(lean(_collapsed), _RESULT)
