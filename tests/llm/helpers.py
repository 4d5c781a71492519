"""Small tables and plain Python versions of the text operators."""

import hashlib
import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Names that the operators use inside.
    + [T.StructField(c, T.StringType()) for c in (
        "bucket", "place", "shard", "slot", "key", "band", "part", "rank", "rep", "u", "v", "n", "letters", "trained",
        "spans", "text_sha256", "best", "group_size", "score")]
)
EXTRA = ("x",) * 19

LONG = " ".join(f"wort{i % 97}ab" for i in range(30_000))
ODD_ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word two"), (5, "word two"), (None, "a text without a number"),
    (None, None), (6, LONG), (7, "1234 !! 55"), (8, "Ünïcödé straße ΑΒΓ 你好"), (9, "WORD"), (10, "w o r d"),
    (11, "x" * 50_000), (12, "same same same " * 40), (13, "same same same " * 40),
]


def frame(spark, rows, langs=("en", "de")):
    data = [(i, t, langs[k % len(langs)] if langs else None, None, None, *EXTRA) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def odd(spark):
    return frame(spark, ODD_ROWS)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingle_set(text, size=5):
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def linked_components(texts: dict, percent: int) -> dict:
    """Smallest id reachable over links of the given similarity, from all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def repeats_removed(texts: dict, width: int = 20) -> dict:
    """id -> (words, removed, digest of what is left), windows in order of id and place."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            own = tuple(w[k : k + width])
            if own in seen:
                gone[k : k + width] = [True] * width
            seen.add(own)
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    return out


def near_copies(seed=5, groups=6, copies=12, length=120, vocabulary=4000):
    """Groups of edited copies around the threshold, chains among them, and unrelated texts."""
    rng = random.Random(seed)
    texts, number = {}, 0
    for _ in range(groups):
        base = [f"v{rng.randrange(vocabulary)}" for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(length)] = f"e{rng.randrange(vocabulary)}"
            texts[number] = " ".join(own)
            number += 1
    for _ in range(20):
        texts[number] = " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(length))
        number += 1
    return texts
