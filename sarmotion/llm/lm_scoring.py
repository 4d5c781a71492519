"""Language-model scoring by context-tree weighting over bytes, beside a unigram base over words.

**The model.** A byte is eight binary decisions; a decision's node (the bits before it) has its own context tree over
the preceding bytes. Counts of (context, byte) are gathered over all training texts for contexts of up to ``DEPTH``
bytes. At every context a Krichevsky-Trofimov estimate stands against the weighted estimate of the longer contexts,
half and half, and the weights that the training data give them are kept: the probability of a byte mixes the
estimates of all depths along its context. Scoring does not change the model, so every row gets the same model.

All contexts of the training texts count, whatever their number. The contexts that more than 2^-SPLIT of the distinct
grams (context and byte) end in form the top of the tree: there are at most 2^SPLIT of them for each depth. What hangs
below the top are subtrees of bounded size, which go to buckets by hash of their root with the grams that they hold. A
bucket weighs its subtrees from the leaves up; their sums give the weights of the top, which is broadcast. Grams that hold
at least 2^-GRAM_SHARE of the training bytes, at most 2^GRAM_SHARE of them, are broadcast with their code lengths. All other
grams of all documents go to the bucket of their subtree, where they are looked up, and come back as one sum for each row
and bucket. So neither bound changes a score. Texts are lower-cased (A-Z), begin after a line break and end with an end byte.

**The base.** Words with a large share of the training tokens, at most 2^WORD_SHARE of them, are broadcast with their
counts. All other words of all documents go to buckets by hash in packed arrays, where they are counted and scored, and
come back as one sum for each row and bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import (
    lean,
    PACKET, bucket_count, by_bucket, gathered, mix64, pack, packets, row_of, scattered, text_slices, total_text_bytes,
    unpack, word_hashes, written,
)

DEPTH = 5
SPLIT = 10
LEAST_GRAMS = 1 << 12  # a subtree of so many grams is never split
BUCKET_GRAMS = 1 << 16  # distinct grams of a bucket, on average
GRAM_SHARE = 21
WORD_SHARE = 19
BYTES, WORDS = 0, 1  # kinds of counts
START, END = 10, 3  # a line break before a text, the end-of-text control code after it
PACKET_TEXT = 8 << 20  # bytes of text for each bucket of grams
MERGE_KEYS = 1 << 19  # keys that wait for the next merge
END_TOKEN = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- context-tree weighting --------------------------------------------------------------------


def framed(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts between ``depth`` start bytes and one end byte; which bytes are scored, and the rows' edges."""
    rows, extra = len(offsets) - 1, depth + 1
    out = np.full(len(data) + rows * extra, START, dtype=np.uint8)
    out[np.arange(len(data)) + row_of(offsets) * extra + depth] = _LOWER[data]
    edges = offsets + np.arange(rows + 1) * extra
    out[edges[1:] - 1] = END
    scored = np.ones(len(out), dtype=bool)
    for k in range(depth):
        scored[edges[:-1] + k] = False
    return out, scored, edges


def gram_keys(framed_bytes: np.ndarray, depth: int) -> np.ndarray:
    """For every place from ``depth`` on: the byte in the low 8 bits, the byte before it above, and so on."""
    n = len(framed_bytes) - depth
    key = np.zeros(n, dtype=np.uint64)
    for k in range(depth + 1):
        key |= framed_bytes[depth - k : depth - k + n].astype(np.uint64) << np.uint64(8 * k)
    return key


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.r_[starts, len(keys)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _counter(depth: int):
    """(key, count) of a task's byte grams, and of its words; merged as they grow."""

    def run(batches):
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                out, scored, _ = framed(data, offsets, depth)
                held[BYTES].append(_runs(gram_keys(out, depth)[scored[depth:]]))
                words, first = word_hashes(data, offsets, lower=True)
                ends = np.full(len(offsets) - 1, END_TOKEN, dtype=np.uint64)
                held[WORDS].append(_runs(np.concatenate([words, ends])))
                for parts in held:
                    if sum(len(k) for k, _ in parts[1:]) >= MERGE_KEYS:
                        parts[:] = [_merged(parts)]
        for kind, parts in enumerate(held):
            if parts:
                keys, counts = _merged(parts)
                for at in range(0, len(keys), 100_000):
                    own = slice(at, at + 100_000)
                    yield pa.record_batch(
                        [pa.array(np.full(len(keys[own]), kind, dtype=np.int32)), pa.array(keys[own].view(np.int64)),
                         pa.array(counts[own].astype(np.int64))],
                        names=["kind", "key", "n"],
                    )

    return lean(run)


_LEVEL_BITS = 8  # below a context in an entry's id: the node, that is a one and the bits before the decision


def _context(keys: np.ndarray, d: int) -> np.ndarray:
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)


def _decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and bits of the eight decisions of each key's byte, as columns."""
    byte = (keys & np.uint64(255)).astype(np.int64)[:, None]
    level = np.arange(8)
    return (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1


@dataclass
class ByteModel:
    """The top of the tree: for each depth its contexts (sorted), and for each context and node what the path down to it
    holds of the probability of a one, and the weight that it passes on."""

    depth: int
    contexts: list[np.ndarray]
    held: list[np.ndarray]
    passed: list[np.ndarray]

    @property
    def log2(self) -> list[np.ndarray]:
        """Log2 probabilities of all 256 bytes behind each context, where the next longer one was never seen."""
        nodes, bits = _decisions(np.arange(256, dtype=np.uint64))
        return [_code(h[:, nodes] + 0.5 * p[:, nodes], bits) for h, p in zip(self.held, self.passed)]

    def roots(self, keys: np.ndarray) -> np.ndarray:
        """The depth of the first context of each key that is not in the top."""
        return _root_depth(keys, self.contexts)


def _root_depth(keys: np.ndarray, tops: list[np.ndarray]) -> np.ndarray:
    root, active = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
    for d, known in enumerate(tops):
        active = active[_common(_context(keys[active], d), known)[1]]
        root[active] = d + 1
    return root


def _code(one: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Log2 probability of bytes from the probabilities of a one at their eight decisions (the last axis)."""
    one = np.clip(one, 1e-9, 1 - 1e-7)
    return np.log2(np.where(bits == 1, one, 1.0 - one)).sum(axis=-1)


def _root_buckets(keys: np.ndarray, root: np.ndarray, buckets: int) -> np.ndarray:
    mask = (np.uint64(1) << (np.uint64(8) * root.astype(np.uint64))) - np.uint64(1)
    return _bucket_of(mix64((keys >> np.uint64(8)) & mask) + root.astype(np.uint64), buckets)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, 0.5) + _log_gamma(b, 0.5) - _log_gamma(a + b, 1.0) - np.log(np.pi)


_SMALL = {more: np.array([math.lgamma(k + more) for k in range(1 << 12)]) for more in (0.5, 1.0)}


def _log_gamma(count: np.ndarray, more: float) -> np.ndarray:
    """Log gamma of ``count + more``: from a table, beyond it by Stirling's series."""
    table = _SMALL[more]
    out = table[np.minimum(count, len(table) - 1).astype(np.int64)]
    large = count >= len(table)
    x = count[large] + more
    inverse = 1 / x
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    out[large] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series
    return out


_HALF = np.log(0.5)


def _stays(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log P_w of contexts that have longer ones, and the weight of stopping there: half the own estimate, half the longer ones'."""
    own = _log_kt(zeros, ones)
    both = np.logaddexp(_HALF + own, _HALF + below)
    return both, np.exp(_HALF + own - both)


@dataclass
class _Level:
    """The seen (context, node) of one depth in the subtrees of a bucket, sorted by id; ``root`` is the subtree's depth."""

    ids: np.ndarray
    root: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stay: np.ndarray

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _common(ids, self.ids)


def _gathered_level(ids, root, *sums):
    order = np.argsort(ids)
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x[order], starts) if len(starts) else np.zeros(0)
    return ids[starts], root[order][starts], [add(x) for x in sums]


def _subtrees(keys: np.ndarray, n: np.ndarray, root: np.ndarray, depth: int) -> list[_Level]:
    """The levels of a bucket's subtrees, weighed from the leaves up; a level has only contexts at or below their root."""
    nodes, bits = _decisions(keys)
    ids = ((_context(keys, depth) << np.uint64(_LEVEL_BITS))[:, None] | nodes.astype(np.uint64)).ravel()
    each = np.repeat(n.astype(np.float64), 8)
    ids, own, (zeros, ones) = _gathered_level(ids, np.repeat(root, 8), each * (bits.ravel() == 0), each * (bits.ravel() == 1))
    levels = [_Level(ids, own, zeros, ones, _log_kt(zeros, ones), np.ones(len(ids)))]
    for d in range(depth - 1, -1, -1):
        last = levels[-1]
        up = last.root <= d
        shorter = last.ids[up] & np.uint64((1 << (8 * d + _LEVEL_BITS)) - 1)
        ids, own, (zeros, ones, below) = _gathered_level(shorter, last.root[up], last.zeros[up], last.ones[up], last.weighted[up])
        levels.append(_Level(ids, own, zeros, ones, *_stays(zeros, ones, below)))
    return levels[::-1]


def _values(keys: np.ndarray, levels: list[_Level], model: ByteModel) -> np.ndarray:
    """Log2 probability of each gram: its byte behind its context, along the top and down its subtree.

    What was never seen has an estimate of a half, whatever is longer.
    """
    if len(keys) > VALUES:
        return np.concatenate([_values(keys[at : at + VALUES], levels, model) for at in range(0, len(keys), VALUES)])
    root = model.roots(keys)
    nodes, bits = _decisions(keys)
    held, passed = np.zeros(nodes.shape), np.ones(nodes.shape)
    for d, known in enumerate(model.contexts):
        rows = np.flatnonzero(root == d + 1)
        at = np.searchsorted(known, _context(keys[rows], d))[:, None]
        held[rows], passed[rows] = model.held[d][at, nodes[rows]], model.passed[d][at, nodes[rows]]
    for d, level in enumerate(levels):
        rows = np.flatnonzero(root <= d)
        ids = (_context(keys[rows], d) << np.uint64(_LEVEL_BITS))[:, None] | nodes[rows].astype(np.uint64)
        at, seen = (x.reshape(ids.shape) for x in level.found(ids.ravel()))
        if not seen.any():
            continue
        here = np.where(seen, (level.ones[at] + 0.5) / (level.zeros[at] + level.ones[at] + 1.0), 0.0)
        stay = np.where(seen, level.stay[at], 0.0)
        held[rows] += passed[rows] * stay * here
        passed[rows] *= 1.0 - stay
    return _code(held + 0.5 * passed, bits)


VALUES = 1 << 15  # grams whose values are worked out at once


def _grams(keys: np.ndarray, first: int, rows: np.ndarray, n: np.ndarray) -> bytes:
    """Grams of a bucket: of the training texts with their counts (``first`` is -1, no rows), or asked for by rows from
    ``first`` on and how often. Keys go without their two highest bytes where those are empty."""
    width = 6 if not len(keys) or int(keys.max()) < 1 << 48 else 8
    return pack(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width], np.array([first], dtype=np.int64), (rows - first).astype(np.uint32), n)


def _gathered_grams(payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows (-1 for training texts) and counts."""
    keys, rows, counts = [], [], []
    for payload in payloads:
        narrow, first, after, n = unpack(payload, np.uint8, np.int64, np.uint32, np.int64)
        wide = np.zeros((len(n), 8), dtype=np.uint8)
        width = len(narrow) // max(len(n), 1)
        wide[:, :width] = narrow.reshape(len(n), width)
        keys.append(wide.view("<u8").ravel().astype(np.uint64))
        rows.append(after.astype(np.int64) + first[0] if first[0] >= 0 else np.full(len(n), -1))
        counts.append(n)
    none = np.zeros(0, np.int64)
    return np.concatenate([*keys, none.view(np.uint64)]), np.concatenate([*rows, none]), np.concatenate([*counts, none])


def _dealt(tops: list[np.ndarray], buckets: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            n = batch.column("n").to_numpy()
            found = scattered(_root_buckets(keys, _root_depth(keys, tops), buckets), buckets, keys, n)
            yield packets([(b, _grams(k, -1, np.zeros(0, np.int64), c)) for b, (k, c) in found])

    return lean(run)


def _root_sums(tops: list[np.ndarray], depth: int):
    """Counts and log P_w of a bucket's roots, summed for each context and node of the top that they hang below."""

    def run(payloads) -> pa.Table:
        keys, _, n = _gathered_grams(payloads)
        levels = _subtrees(keys, n, _root_depth(keys, tops), depth)
        parts = []
        for d, level in enumerate(levels[1:]):
            top = level.root == d + 1
            parent = level.ids[top] & np.uint64((1 << (8 * d + _LEVEL_BITS)) - 1)
            ids, _, sums = _gathered_level(parent, level.root[top], level.zeros[top], level.ones[top], level.weighted[top])
            parts.append(pa.table({
                "depth": np.full(len(ids), d, dtype=np.int32), "id": ids.view(np.int64),
                **dict(zip(("zeros", "ones", "weighted"), sums))}))
        return pa.concat_tables(parts)

    return run


def _frequent_values(model, depth: int, least: int):
    """Log2 probability of the training grams of a bucket that occur ``least`` times."""

    def run(payloads) -> pa.Table:
        keys, _, n = _gathered_grams(payloads)
        often = keys[n >= least]
        values = _values(often, _subtrees(keys, n, model.value.roots(keys), depth), model.value) if len(often) else np.zeros(0)
        return pa.table({"key": often.view(np.int64), "log2": values})

    return run


def _asked_values(model, depth: int, buckets: int):
    """Bits of the grams that rows ask for: one sum for each row."""

    def run(payloads) -> pa.Table:
        keys, rows, n = _gathered_grams(payloads)
        known = rows < 0
        wanted, place = np.unique(keys[~known], return_inverse=True)
        if not len(wanted):
            return pa.Table.from_batches([packets([])])
        tree = keys[known]
        bits = -_values(wanted, _subtrees(tree, n[known], model.value.roots(tree), depth), model.value)
        own, at = np.unique(rows[~known], return_inverse=True)
        sums = np.bincount(at, bits[place] * n[~known])
        found = scattered(_bucket_of(own.view(np.uint64), buckets), buckets, own, sums)
        return pa.Table.from_batches([packets([(b, pack(*arrays)) for b, arrays in found])])

    return run


def _bits_summed(payloads) -> pa.Table:
    rows, bits = gathered(payloads, np.int64, np.float64)
    own, place = np.unique(rows, return_inverse=True)
    return pa.table({"row": own, "bits": np.bincount(place, bits)})


def top_contexts(counts: DataFrame, depth: int, grams: int) -> list[np.ndarray]:
    """For each depth below ``depth`` the contexts that hold more distinct grams than a subtree may; at most 2^SPLIT each."""
    most = max(LEAST_GRAMS, grams >> SPLIT)
    every = F.inline(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context"))
        for d in range(depth)]))
    if grams <= most or not depth:
        return [np.zeros(0, np.uint64)] * depth
    found = counts.select(every).groupBy("depth", "context").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > most).select("depth", "context").toArrow()
    of, context = found.column("depth").to_numpy(), found.column("context").to_numpy().view(np.uint64)
    return [np.sort(context[of == d]) for d in range(depth)]


def byte_model(counts: DataFrame, depth: int = DEPTH) -> ByteModel:
    """The weighted top of the tree over all of the (key, n) counts of byte grams."""
    grams = counts.count()
    tops = top_contexts(counts, depth, grams)
    return _weighted_top(_dealt_grams(counts, tops, gram_buckets(counts.sparkSession, grams)), tops, depth)


def gram_buckets(spark, grams: int, text_bytes: int = 0) -> int:
    return max(bucket_count(spark, text_bytes, PACKET_TEXT), -(-grams // BUCKET_GRAMS))


def _dealt_grams(counts: DataFrame, tops: list[np.ndarray], buckets: int) -> DataFrame:
    return counts.select("key", "n").mapInArrow(_dealt(tops, buckets), PACKET)


def _weighted_top(dealt: DataFrame, tops: list[np.ndarray], depth: int) -> ByteModel:
    """Context-tree weighting of the top: P_w at a context is half its own estimate and half the product over its longer
    contexts, those of the top and the roots of subtrees. At most 2^SPLIT contexts a depth with 255 nodes reach the driver."""
    shape = [(len(t), 256) for t in tops]
    sums = {c: [np.zeros(x) for x in shape] for c in ("zeros", "ones", "weighted")}
    if shape and len(tops[0]):
        rows = by_bucket(dealt, _root_sums(tops, depth), "depth int, id long, zeros double, ones double, weighted double")
        found = rows.groupBy("depth", "id").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
        of, ids = found.column("depth").to_numpy(), found.column("id").to_numpy().view(np.uint64)
        for d, known in enumerate(tops):
            own = of == d
            at, node = np.searchsorted(known, ids[own] >> np.uint64(_LEVEL_BITS)), (ids[own] & np.uint64(255)).astype(np.int64)
            for c, into in sums.items():
                into[d][at, node] = found.column(c).to_numpy()[own]
    stay: list = [None] * len(tops)
    for d in range(len(tops) - 1, -1, -1):
        zeros, ones, below = (sums[c][d] for c in ("zeros", "ones", "weighted"))
        weighted, stay[d] = _stays(zeros, ones, below)
        if d:
            parent = np.searchsorted(tops[d - 1], tops[d] & np.uint64((1 << (8 * (d - 1))) - 1))
            for c, own in (("zeros", zeros), ("ones", ones), ("weighted", weighted)):
                np.add.at(sums[c][d - 1], parent, own)
    held, passed = [], []
    for d, known in enumerate(tops):
        here = (sums["ones"][d] + 0.5) / (sums["zeros"][d] + sums["ones"][d] + 1.0)
        before, weight = np.zeros(shape[d]), np.ones(shape[d])
        if d:
            parent = np.searchsorted(tops[d - 1], known & np.uint64((1 << (8 * (d - 1))) - 1))
            before, weight = held[d - 1][parent], passed[d - 1][parent]
        held.append(before + weight * stay[d] * here)
        passed.append(weight * (1.0 - stay[d]))
    return ByteModel(depth, tops, held, passed)


# ---- words -------------------------------------------------------------------------------------


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) % np.uint64(buckets)


SUMS = "row long, logs double, known long"
# A row's own sums (without bucket and payload), or a packet of its rare words (with nothing else).
PASSED = "row long, doc_id long, logs double, known long, tokens long, bits double, kind int, bucket int, payload binary"
_PASSED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("logs", pa.float64()), ("known", pa.int64()), ("tokens", pa.int64()),
    ("bits", pa.float64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _passed(n: int, **columns) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _PASSED], schema=_PASSED)


def _common(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return at, known[at] == words


def _scorer(model, grams, frequent, depth: int, gram_buckets: int, buckets: int, flush: int = 500_000):
    """A row's tokens, and the sums over its frequent grams, its frequent words and its end; its other grams go to the
    buckets of their subtrees and its other words to buckets by hash, with the row and whether it trains."""

    def sent(kind, found):
        return _passed(
            len(found), kind=np.full(len(found), kind, dtype=np.int32), bucket=[b for b, _ in found],
            payload=[p for _, p in found])

    def sent_words(waiting):
        words, rows, trained = (np.concatenate(x) for x in zip(*waiting))
        found = scattered(_bucket_of(words, buckets), buckets, words, rows, trained)
        return sent(WORDS, [(b, pack(*arrays)) for b, arrays in found])

    def sent_grams(waiting):
        keys, rows = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        # Equal grams of a row travel once.
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])
        n = np.diff(np.r_[starts, len(keys)])
        keys, rows = keys[starts], rows[starts]
        bucket = _root_buckets(keys, model.value.roots(keys), gram_buckets)
        first = int(rows[0])  # the rows of a task follow one another
        return sent(BYTES, [(b, _grams(k, first, r, c)) for b, (k, r, c) in scattered(bucket, gram_buckets, keys, rows, n)])

    def run(batches):
        often, log2 = grams.value
        known, counts, end_count = frequent.value
        logs_of = np.log10(counts + 0.5)
        held = {BYTES: ([], sent_grams), WORDS: ([], sent_words)}
        size = {BYTES: 0, WORDS: 0}
        for batch in batches:
            rows = batch.column("row").to_numpy()
            trained = batch.column("trained").to_numpy(zero_copy_only=False).astype(np.uint8)
            for row, end, data, offsets in text_slices(batch.column("text")):
                out, scored, edges = framed(data, offsets, depth)
                keys = gram_keys(out, depth)[scored[depth:]]
                owner = np.repeat(np.arange(end - row), np.diff(edges) - depth)
                order = np.argsort(keys)
                keys, owner = keys[order], owner[order]
                at, common = _common(keys, often)
                bits = -np.bincount(owner[common], log2[at[common]], end - row)
                held[BYTES][0].append((keys[~common], rows[owner[~common] + row]))
                size[BYTES] += len(keys) - int(common.sum())
                words, first = word_hashes(data, offsets, lower=True)
                owner = row_of(first)
                at, common = _common(words, known)
                logs = np.bincount(owner[common], logs_of[at[common]], end - row) + np.log10(end_count + 0.5)
                hits = np.bincount(owner[common], minlength=end - row) + (end_count > 0)
                yield _passed(
                    end - row, row=rows[row:end], doc_id=batch.column("doc_id").slice(row, end - row), logs=logs,
                    known=hits.astype(np.int64), tokens=np.diff(first).astype(np.int64) + 1, bits=bits)
                rare = owner[~common] + row
                held[WORDS][0].append((words[~common], rows[rare], trained[rare]))
                size[WORDS] += len(rare)
                for kind, (waiting, send) in held.items():
                    if size[kind] >= flush:
                        yield send(waiting)
                        waiting.clear()
                        size[kind] = 0
        for kind, (waiting, send) in held.items():
            if size[kind]:
                yield send(waiting)

    return lean(run)


def _counted_words(buckets: int):
    """Count a bucket's words over the training rows; answer with one sum for each row."""

    def run(payloads) -> pa.Table:
        words, rows, trained = gathered(payloads, np.uint64, np.int64, np.uint8)
        order = np.argsort(words, kind="stable")
        words = words[order]
        starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        count = np.add.reduceat(trained[order].astype(np.int64), starts)
        each = np.empty(len(words), dtype=np.int64)
        each[order] = np.repeat(count, np.diff(np.r_[starts, len(words)]))
        own, place = np.unique(rows, return_inverse=True)
        logs, known = np.bincount(place, np.log10(each + 0.5)), np.bincount(place, each > 0).astype(np.int64)
        found = scattered(_bucket_of(own.view(np.uint64), buckets), buckets, own, logs, known)
        return pa.Table.from_batches([packets([(b, pack(*arrays)) for b, arrays in found])])

    return run


def _summed(payloads) -> pa.Table:
    rows, logs, known = gathered(payloads, np.int64, np.float64, np.int64)
    own, place = np.unique(rows, return_inverse=True)
    return pa.table({"row": own, "logs": np.bincount(place, logs), "known": np.bincount(place, known).astype(np.int64)})


def scored(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    trained_col: str | None = None, depth: int = DEPTH,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits of every whole text.

    ``trained_col`` names a boolean column of ``docs``: the model learns from the rows where it is true (all rows
    without it). ``score`` is the log10 probability of the text by the byte model, ``base_score`` by the unigram
    base. A null or empty text is its end alone. Every row is scored by itself: rows are told apart by a number of their own,
    so those that repeat a doc_id or have none keep a result each. Other columns are not read. Without training rows all estimates
    are those of no evidence; an empty table gives an empty result. A control code 3 inside a text is scored as an end.
    """
    spark = docs.sparkSession
    trained = F.coalesce(F.col(trained_col), F.lit(False)) if trained_col else F.lit(True)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), trained.alias("trained")
    )
    text_bytes = total_text_bytes(base)
    buckets = bucket_count(spark, text_bytes)
    counts = written(
        base.where("trained").select("text").mapInArrow(_counter(depth), "kind int, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))
    )
    bytes_ = counts.where(F.col("kind") == BYTES).select("key", "n")
    seen = bytes_.agg(F.count(F.lit(1)).alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tops = top_contexts(bytes_, depth, seen["grams"])
    subtrees = gram_buckets(spark, seen["grams"], text_bytes)
    dealt = _dealt_grams(bytes_, tops, subtrees)
    model = spark.sparkContext.broadcast(_weighted_top(dealt, tops, depth))
    often = by_bucket(dealt, _frequent_values(model, depth, max(2, seen["n"] >> GRAM_SHARE)), "key long, log2 double").toArrow()
    keys = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    grams = spark.sparkContext.broadcast((keys[order], often.column("log2").to_numpy()[order]))
    words = counts.where(F.col("kind") == WORDS)
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(row["n"]), int(row["v"])
    end_key = int(END_TOKEN.astype(np.int64))
    end_count = words.where(F.col("key") == end_key).agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = words.where((F.col("n") >= max(2, total >> WORD_SHARE)) & (F.col("key") != end_key)).select("key", "n").toArrow()
    keys = heavy.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], heavy.column("n").to_numpy()[order].astype(np.float64), int(end_count)))
    # One pass over the texts; what it finds is written, so that a row's number is the same wherever it is used.
    passed = written(
        base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scorer(model, grams, frequent, depth, subtrees, buckets), PASSED))
    own = passed.where("bucket is null").select("row", "doc_id", "logs", "known", "tokens", "bits")
    asked = lambda kind: passed.where(F.col("kind") == kind).select("bucket", "payload")
    rare = by_bucket(by_bucket(asked(WORDS), _counted_words(buckets), PACKET), _summed, SUMS)
    looked_up = by_bucket(dealt.unionByName(asked(BYTES)), _asked_values(model, depth, buckets), PACKET)
    below = by_bucket(looked_up, _bits_summed, "row long, bits double")
    every = own.unionByName(rare, allowMissingColumns=True).unionByName(below, allowMissingColumns=True)
    sums = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("logs", "known", "tokens", "bits")))
    return sums.select(
        "doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2.0))).alias("score"), "bits",
    )
