"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

Two permutations give every signature coordinate. The first, sigma, places a shingle on a ring of 2^32 places.
The second, pi, is a bijection of that ring; coordinate k is the smallest pi(sigma(x) + k), that is pi shifted
by k places. Bands of consecutive coordinates name candidate buckets; links are confirmed on full shingle sets.

Buckets are not expanded into pairs. In a bucket every member is compared with the member of the smallest id
(the centre). Members that are not linked with the centre, if there are any, are then compared with the whole
bucket in blocks: tasks of two bounded groups of texts that count exact intersections and return a spanning set of
links. So no link between documents that share a band is lost, whatever the size of the bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, mix64, text_slices, window_hashes, word_hashes, written
from sarmotion.llm.components import components
from sarmotion.llm.idfilter import thinned

ROWS_PER_BAND = 4
MISS = 1e-6
BLOCK = 512
_RING = np.uint64(0xA24BAED4963EE407)


def bands_needed(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands for which a pair at the threshold shares none with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1.0 - threshold**rows)) if threshold < 1.0 else 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted and joined, with the rows' edges.

    Words are lower-cased (A-Z). A row of fewer words than a shingle has its whole sequence as the only one.
    """
    words, first = word_hashes(data, offsets, lower=True)
    counts = np.diff(first)
    full = window_hashes(words, size)
    sets = []
    for row in range(len(counts)):
        n, at = counts[row], first[row]
        if n >= size:
            sets.append(np.unique(full[at : at + n - size + 1]))
        elif n:
            sets.append(mix64(window_hashes(words[at : at + n], n) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), edges


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place (the finaliser of a public 32-bit hash)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """Circulant MinHash coordinates, one row of ``width`` for each set that is not empty."""
    starts = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(starts), width), dtype=np.uint32)
    if len(starts):
        ring = (mix64(shingles ^ _RING) >> np.uint64(32)).astype(np.uint32)
        for k in range(width):
            out[:, k] = np.minimum.reduceat(_pi(ring + np.uint32(k)), starts)
    return out


def _sketches(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for row, end, data, offsets in text_slices(text):
                shingles, edges = shingle_sets(data, offsets, size)
                n = np.diff(edges)
                some = n > 0
                sig = signatures(shingles, edges, bands * rows).astype(np.uint64)
                keys = np.zeros((len(sig), bands), dtype=np.uint64)
                for k in range(rows):
                    keys = mix64(keys * np.uint64(31) + sig[:, k::rows])
                keys = mix64(keys ^ np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                digest = np.zeros((2, len(n)), dtype=np.uint64)
                if some.any():
                    starts = edges[:-1][some]
                    digest[0, some] = np.add.reduceat(mix64(shingles + np.uint64(11)), starts)
                    digest[1, some] = np.add.reduceat(mix64(shingles ^ np.uint64(0xC3A5C85C97CB3127)), starts)
                flat = pa.array(keys.view(np.int64).ravel())
                list_edges = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(row, end - row),
                        pa.array(n.astype(np.int64)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(list_edges), flat),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return lean(run)


def _set_of(text: str, size: int) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), size)[0]


def _percent(threshold: float) -> int:
    return round(threshold * 100)


def _verified(size: int, percent: int):
    """Exact link decision of (a, b, text_a, text_b); neighbouring rows often share a."""

    def run(batches):
        for batch in batches:
            a_ids = batch.column("a").to_pylist()
            a_text, b_text = batch.column("text_a"), batch.column("text_b")
            linked = np.zeros(batch.num_rows, dtype=bool)
            last, left = None, None
            for row, end, data, offsets in text_slices(b_text):
                sets, edges = shingle_sets(data, offsets, size)
                for i in range(row, end):
                    if left is None or a_ids[i] != last:
                        last, left = a_ids[i], _set_of(a_text[i].as_py(), size)
                    right = sets[edges[i - row] : edges[i - row + 1]]
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    linked[i] = len(left) and 100 * both >= percent * (len(left) + len(right) - both)
            yield pa.record_batch(
                [batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"]
            )

    return lean(run)


def _spanning(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``hit`` joins, fewer than there are ids."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in zip(*np.nonzero(hit)):
        x, y = int(left[i]), int(right[j])
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _intersections(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all left with all right sets, by products of 0/1 blocks over shared shingles."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    place = []
    for sets, flat in ((left, a), (right, b)):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == flat[ok]
        order = np.argsort(at[ok], kind="stable")
        place.append((rows[ok][order], at[ok][order]))
    for low in range(0, len(shared), step):
        wide = min(step, len(shared) - low)
        blocks = []
        for (rows, at), sets in zip(place, (left, right)):
            lo, hi = np.searchsorted(at, [low, low + wide])
            block = np.zeros((len(sets), wide), dtype=np.float32)
            block[rows[lo:hi], at[lo:hi] - low] = 1.0
            blocks.append(block)
        counts += blocks[0] @ blocks[1].T
    return counts


def _block_links(size: int, percent: int):
    """Links between the unresolved members and all members of one pair of a bucket's blocks."""

    def run(part: pa.Table) -> pa.Table:
        ids = np.array(part.column("doc_id").to_pylist(), dtype=np.int64)
        role = np.array(part.column("role").to_pylist(), dtype=np.int64)
        texts = part.column("text").to_pylist()
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets: dict[int, np.ndarray] = {}
            for i, t in zip(ids, texts):
                if i not in sets:
                    sets[i] = _set_of(t, size)
            a, b = [sets[i] for i in ids[left]], [sets[i] for i in ids[right]]
            both = _intersections(a, b)
            total = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
            links = _spanning(ids[left], ids[right], 100.0 * both >= percent * total)
        return pa.table({
            "u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64()),
        })

    return lean(run)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.85,
    shingle: int = 5,
    rows: int = ROWS_PER_BAND,
    miss: float = MISS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``threshold`` (a whole number of per cent); a component's smallest doc_id is kept. A pair at the threshold
    is missed with a probability of at most ``miss``, a more similar one with less.

    Null and empty texts and texts without words have no shingles, link with nothing and are kept. A null
    doc_id links with nothing: component_id is null and the row is kept. Rows that repeat a doc_id each get
    their own n_shingles and share the component. Other columns are not read, so their names cannot clash.
    Empty tables give an empty result.
    """
    percent = _percent(threshold)
    bands = bands_needed(threshold, rows, miss)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(base.mapInArrow(
        _sketches(shingle, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    ))

    # Equal sets first: one representative each, whatever the number of copies.
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    # Aggregates that are joined back are written first: both sides are then shuffled for the join, and the partitions
    # of a hot group can be split.
    same = written(usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    copies = usable.select("doc_id", "d1", "d2", "n_shingles").join(same, ["d1", "d2", "n_shingles"])
    copies = written(copies.select("doc_id", "rep"))
    reps = copies.where("doc_id = rep").select("doc_id").distinct()
    keyed = usable.join(reps, "doc_id").select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))

    # Buckets and their centres.
    buckets = written(keyed.groupBy("band", "key").agg(
        F.min(F.struct("doc_id", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("n")
    ).where("n > 1"))
    members = written(keyed.join(buckets, ["band", "key"]).select(
        "band", "key", "doc_id", F.col("c.doc_id").alias("centre"), "n",
        # Sizes alone can rule a link out.
        (100 * F.least("n_shingles", "c.n_shingles") >= percent * F.greatest("n_shingles", "c.n_shingles")).alias("fits"),
    ))
    wanted = members.groupBy("doc_id").agg(F.lit(1).alias("_")).select("doc_id")
    texts = written(thinned(base, wanted).join(wanted, "doc_id", "left_semi"))

    stars = members.where("fits and doc_id <> centre").groupBy("centre", "doc_id").agg(F.lit(1).alias("_"))
    pairs = (
        stars.select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    tested = written(pairs.mapInArrow(_verified(shingle, percent), "a long, b long, linked boolean"))
    linked = tested.where("linked").select("a", "b").distinct()

    # Members that their bucket's centre does not explain meet the whole bucket, in blocks.
    state = members.where("n > 2").join(
        linked.select(F.col("a").alias("centre"), F.col("b").alias("doc_id"), F.lit(True).alias("linked")),
        ["centre", "doc_id"], "left",
    ).where("doc_id <> centre").select("band", "key", "doc_id", "n", F.coalesce("linked", F.lit(False)).alias("linked"))
    open_buckets = state.where("not linked").groupBy("band", "key").agg(F.count(F.lit(1)).alias("open"))
    state = state.join(open_buckets, ["band", "key"]).withColumns({
        "blocks": F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"),
        "block": F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int"),
    })
    grid = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = state.where("not linked").select("band", "key", "doc_id", F.col("block").alias("i"), grid, F.lit(0).alias("role"))
    left = left.withColumnRenamed("other", "j")
    right = state.select("band", "key", "doc_id", grid, F.col("block").alias("j"), F.lit(1).alias("role"))
    right = right.withColumnRenamed("other", "i").select("band", "key", "doc_id", "i", "j", "role")
    meet = left.unionByName(right).join(texts, "doc_id")
    spanned = meet.groupBy("band", "key", "i", "j").applyInArrow(_block_links(shingle, percent), "u long, v long")

    edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(spanned.where("u <> v"))
    found = components(edges).select(F.col("doc_id").alias("rep"), "component_id")
    labels = copies.join(found, "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component_id", "rep")).alias("component_id")
    )
    return (
        sketches.select("doc_id", "n_shingles")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        )
    )
