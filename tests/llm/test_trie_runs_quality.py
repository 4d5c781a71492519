"""The prefix trie, periodic runs and the quality classifier against plain versions, and on odd rows."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import EXTRA, LONG, ODD_ROWS, frame, nothing, odd, words  # noqa: E402

from sarmotion.llm import periodic_runs, prefix_trie, quality  # noqa: E402
from sarmotion.llm.common import crc_mod, mix64, text_buffer  # noqa: E402

SMALL = "/root/testdata/sf0.001"

# ---- 11 prefix trie --------------------------------------------------------------------------


def plain_trie(rows):
    """(conv_id, depth) -> the other columns, from whole paths."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            by.setdefault(conv, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(found)] for c, found in by.items()}
    nodes, children = {}, {}
    ends = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + ((len(nodes[path]) - 1) * len(path[-1][1]) if path else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out[min(nodes[path]), len(path)] = (
            min(nodes[path[:-1]]) if path else None, len(nodes[path]), len(below), leaves[path], saved[path], digest)
    return out


def conversations(spark, rows):
    extra = ", ".join(f"{x} string" for x in ("c", "depth", "k1", "m", "size", "weight", "block", "part"))
    return spark.createDataFrame([(*r, *EXTRA[:8]) for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def trie(spark, rows, **options):
    found = prefix_trie.prefix_trie(conversations(spark, rows), **options).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}
    assert len(out) == len(found)
    return out


def odd_conversations():
    rng = random.Random(4)
    rows = [(None, 1, "user", "x"), (77_705, None, None, None)]
    for c in [*range(40), *range(300, 330), 507, 508, 1001]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice([None, "user", "a"]), rng.choice([None, "x", "yy", "zzz ü"])))
    return rows + rows[40:60]


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 7])
def test_trie_of_odd_conversations(spark, limit):
    rows = odd_conversations()
    assert trie(spark, rows, limit=limit) == plain_trie(rows)


def test_trie_of_long_paths_and_a_common_conversation(spark):
    """Chains longer than a block of depths, one conversation with most rows, and many copies, cut across tasks."""
    rows = [(5000, t, "u", str(t % 7)) for t in range(prefix_trie.BLOCK + 900)] + [(5001, t, "u", str(t % 7)) for t in range(1500)]
    rows += [(c, t, "u", f"same {t}") for c in range(600, 690) for t in range(5)]
    assert trie(spark, rows, limit=400) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == {}
    # Six turns are asked of a conversation that is not there, and the own ones are fewer.
    taken = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(taken, 0, "u", "x")]
    assert trie(spark, rows) == plain_trie(rows) == {
        (taken, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(taken).encode()).hexdigest())}


def test_centroid_sums_equal_plain_sums():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 80)
        parent = np.array([-1] + [rng.choice([-1, i - 1]) if rng.random() < 0.1 else rng.choice([i - 1, rng.randrange(i)]) for i in range(1, n)])
        weight = np.array([rng.randrange(1, 5) for _ in range(n)])
        values = np.array([[rng.randrange(9), rng.randrange(9)] for _ in range(n)])
        whole, sums = weight.copy(), values.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                whole[parent[i]] += whole[i]
                sums[parent[i]] += sums[i]
        order = np.array(rng.sample(range(n), n))
        place = np.argsort(order)
        dealt = np.where(parent[order] >= 0, place[np.maximum(parent[order], 0)], -1)
        assert (prefix_trie.decomposed(dealt, whole[order], values[order]) == sums[order]).all()


# ---- 12 periodic runs ------------------------------------------------------------------------


def plain_runs(w):
    """(start, length, period) of every run, trying every period at every place."""
    n, out = len(w), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(24, 3 * p):
                own = w[i : i + size]
                if not any(all(own[k] == own[k + q] for k in range(size - q)) for q in range(1, p)):
                    out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(text, key=None):
    w = words(text)
    n, h = len(w), zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (
        len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_words(rng):
    out = []
    for _ in range(rng.randrange(0, 8)):
        kind = rng.randrange(3)
        if kind == 0:
            out += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(60))]
        elif kind == 1:
            out += [rng.randrange(3)] * rng.randrange(1, 60)
        else:
            block = [rng.randrange(rng.choice([2, 30])) for _ in range(rng.randrange(1, 40))]
            out += (block * 8)[: rng.randrange(1, len(block) * 7 + 1)]
    return out


def test_tiles_find_every_run():
    rng = random.Random(3)
    for _ in range(150):
        rows = [periodic_words(rng) for _ in range(rng.randrange(1, 5))]
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        items = mix64(np.array([x for r in rows for x in r], dtype=np.uint64) + np.uint64(7))
        row, period, low, high = periodic_runs.joined(*periodic_runs.tile_intervals(items, first))
        for i, own in enumerate(rows):
            got = [(a, b - a + q, q) for r, q, a, b in zip(row.tolist(), period.tolist(), low.tolist(), high.tolist())
                   if r == i and b - a + q >= max(24, 3 * q)]
            assert sorted(got, key=lambda r: (r[0], r[2])) == plain_runs(own)


def test_tiles_of_one_row_are_stitched_by_the_shuffle(spark):
    """Intervals straight from the tiles, unjoined, give the same runs."""
    own = [0] * 200 + list(range(40)) * 9 + [1, 2, 3] * 30
    items = mix64(np.array(own, dtype=np.uint64) + np.uint64(7))
    row, period, low, high = periodic_runs.tile_intervals(items, np.array([0, len(own)]))
    assert len(row) > 10
    frame_ = spark.createDataFrame(
        [tuple(map(int, x)) for x in zip(row, period, low, high)], "row long, period long, low long, high long").repartition(5)
    found = periodic_runs.stitched(frame_).select("start", "length", "period").collect()
    assert sorted(map(tuple, found), key=lambda r: (r[0], r[2])) == plain_runs(own)


RUN_TEXTS = [
    *[" ".join(f"w{x}" for x in periodic_words(random.Random(seed))) for seed in range(40)],
    " ".join(["a b c d e f g"] * 4 + ["x"] + ["a b c d e f g"] * 4), "ab " * 23, "ab " * 24, "Ab ab " * 12,
]


def test_runs_of_texts(spark):
    rows = [(i, t) for i, t in enumerate(RUN_TEXTS)] + [r for r in ODD_ROWS if r[1] != LONG]
    for planted in (None, F.col("doc_id").cast("string")):
        found = periodic_runs.periodic_runs(frame(spark, rows).repartition(3), planted=planted).collect()
        want = [(i, *plain_row(t, None if planted is None or i is None else str(i))) for i, t in rows]
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_runs_of_a_long_text_and_of_nothing(spark):
    assert periodic_runs.periodic_runs(nothing(spark)).count() == 0
    (row,) = periodic_runs.periodic_runs(frame(spark, [(6, LONG)])).collect()
    # 97 words over and over.
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 30_000, 97)
    assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(LONG.encode().split()[:97])).hexdigest()


# ---- 13 quality ------------------------------------------------------------------------------


def test_statistics_of_a_text():
    data, offsets = text_buffer(__import__("pyarrow").array(["", "Aa bb, Aa 12!\nüx aa", None, "a"]))
    found = quality.statistics(data, offsets)
    at = quality.STATISTICS.index
    root = lambda a, b: np.arcsin(np.sqrt(a / b))
    assert (found[0] == 0).all() and (found[2] == 0).all()
    row = found[1]
    assert row[at("log_words")] == pytest.approx(np.log1p(6))
    assert row[at("upper")] == pytest.approx(root(2, 10)) and row[at("wide")] == pytest.approx(root(1, 10))
    assert row[at("digit")] == pytest.approx(root(2, 19)) and row[at("line_break")] == pytest.approx(root(1, 19))
    # Words are compared without case.
    assert row[at("commonest")] == pytest.approx(root(3, 6))
    assert row[at("distinct")] == pytest.approx(np.log1p(4) / np.log1p(6))
    alone = quality.statistics(*text_buffer(__import__("pyarrow").array(["Aa bb, Aa 12!\nüx aa"])))
    assert alone[0] == pytest.approx(row)


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(2)
    width = len(quality.STATISTICS)
    x = rng.normal(size=(300, width)) @ rng.normal(size=(width, width)) * 0.3
    y = (rng.random(300) < 0.7).astype(int)
    moments, parts = quality.Moments(), [quality.Moments(), quality.Moments()]
    moments.add(x, y)
    for part, rows in zip(parts, (slice(0, 100), slice(100, 300))):
        part.add(x[rows], y[rows])
    assert parts[0].flat() + parts[1].flat() == pytest.approx(moments.flat())
    model = quality.Moments.of(moments.flat()).model(0.3, 0.1, 0.5)
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / 300
    logs = []
    for k in (0, 1):
        cov = 0.7 * np.cov(x[y == k].T, bias=True) + 0.3 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(pooled)) + quality.FLOOR * np.eye(width)
        away = x - x[y == k].mean(axis=0)
        logs.append(-0.5 * ((away @ np.linalg.inv(cov)) * away).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.log_ratio(x) == pytest.approx(logs[1] - logs[0])
    prior = (y.sum() + 1) / 302
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-0.5 * (logs[1] - logs[0])) * (1 - prior) / prior))


def test_quality_of_rows_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    blind = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    found = quality.quality(blind, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    low = [r["score"] for r in found if r["quality"] == 0]
    high = [r["score"] for r in found if r["quality"] == 1]
    assert len(low) > 5 and np.mean([s < 0.3 for s in low]) > 0.9 and np.mean([s >= 0.3 for s in high]) > 0.98


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame(
        [(4, 1), (5, 0), (5, 1), (6, 1), (7, 0), (9, None), (None, 1), (11, 0), (12, 1)], "doc_id long, quality int")
    found = quality.quality(odd(spark), labels).collect()
    assert len(found) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in found)
    same = {r["score"] for r in found if r["doc_id"] in (12, 13)}
    assert len(same) == 1
    assert quality.quality(nothing(spark), labels).count() == 0
    none = quality.quality(odd(spark), labels.where("quality > 5")).collect()
    assert {r["score"] for r in none} == {0.5}
    one = quality.quality(odd(spark), labels.where("quality = 1")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.5
