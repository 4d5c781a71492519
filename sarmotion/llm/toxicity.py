"""Toxicity from a learned lexicon, its misspellings and the context of every hit.

The lexicon is learned from labelled rows: words of toxic documents that clean ones lack, in several different
contexts (so copies of one passage do not count as evidence). Its trie is intersected with Levenshtein automata: a
state is a set of (trie node, edits so far), made when a text first needs it, so matching a word is one table look-up for
each character. A hit's window of neighbouring words tells quotation from abuse. A logistic regression turns the
hits into a probability.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, text_slices, written

SAMPLE_ROWS = 24_000
MAX_TERMS = 2048
MIN_CONTEXTS = 3
MIN_SHARE = 0.8
WINDOW = 6
QUOTES = "\"“”„«»‹›‟"
FEATURES = 6
# Weights before any evidence: exact, one edit, two edits, outside and then inside quotation.
PRIOR = np.array([2.5, 1.0, 0.5, 0.4, 0.2, 0.1])
PRIOR_BIAS = -2.5

_WORD = re.compile(r"[^\W_]+")


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


def _code_table(size: int = 0x30000) -> tuple[np.ndarray, np.ndarray]:
    """Lower case and word membership of code points; those beyond the table are word characters."""
    lower = np.arange(size, dtype=np.uint32)
    word = np.zeros(size, dtype=bool)
    for c in range(size):
        small = chr(c).lower()
        lower[c] = ord(small) if len(small) == 1 and ord(small) < size else c
        word[c] = chr(c).isalnum()
    return lower, word


_LOWER, _IS_WORD = _code_table()


def documents_needed(share: float, words: int) -> int:
    """Toxic documents in a row that, by chance alone, less than one of so many words would show."""
    if not 0.0 < share < 1.0:
        return 2
    return max(2, math.ceil(math.log(max(words, 2)) / -math.log(share)))


class LexiconAutomaton:
    """Determinised on demand: (trie node, edits) sets as states, characters of the lexicon as classes."""

    def __init__(self, terms: list[str]):
        letters = sorted({c for t in terms for c in t})
        self.classes = len(letters) + 1
        self.code_class = np.zeros(len(_LOWER), dtype=np.int32)
        self._class = {c: i + 1 for i, c in enumerate(letters)}
        for c, i in self._class.items():
            if ord(c) < len(self.code_class):
                self.code_class[ord(c)] = i
        self.children: list[dict[int, int]] = [{}]
        self.limit: list[int] = [-1]  # edits allowed where a term ends, -1 elsewhere
        self.most: list[int] = [0]  # the most edits of any term below
        for term in terms:
            node, allowed = 0, edits_allowed(len(term))
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                step = self.children[node]
                if self._class[c] not in step:
                    step[self._class[c]] = len(self.children)
                    self.children.append({})
                    self.limit.append(-1)
                    self.most.append(0)
                node = step[self._class[c]]
                self.most[node] = max(self.most[node], allowed)
            self.limit[node] = max(self.limit[node], allowed)
        self.longest = max((len(t) for t in terms), default=0) + 2
        self.shortest = max(1, min((len(t) - edits_allowed(len(t)) for t in terms), default=1))
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.table = np.full((256, self.classes), -1, dtype=np.int32)
        self.distance = np.full(256, 9, dtype=np.int8)
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, held: dict[int, int]) -> dict[int, int]:
        """Characters of a term may be missing from the text: one edit for each."""
        queue = list(held.items())
        while queue:
            node, edits = queue.pop()
            if held.get(node, 9) < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and held.get(child, 9) > edits + 1:
                    held[child] = edits + 1
                    queue.append((child, edits + 1))
        return held

    def _state(self, held: dict[int, int]) -> int:
        key = tuple(sorted(held.items()))
        if key not in self.states:
            number = len(self.members)
            self.states[key] = number
            self.members.append(key)
            if number == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.distance = np.concatenate([self.distance, np.full_like(self.distance, 9)])
            self.distance[number] = min((e for n, e in key if e <= self.limit[n]), default=9)
        return self.states[key]

    def _advance(self, state: int, char: int) -> int:
        held: dict[int, int] = {}
        for node, edits in self.members[state]:
            if edits + 1 <= self.most[node] and held.get(node, 9) > edits + 1:
                held[node] = edits + 1  # a character too many
            for c, child in self.children[node].items():
                cost = edits + (c != char)
                if cost <= self.most[child] and held.get(child, 9) > cost:
                    held[child] = cost
        return self._state(self._closed(held))

    def distances(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Edits to the nearest term within its allowance for every word of the buffer; 9 if there is none."""
        out = np.full(len(starts), 9, dtype=np.int8)
        alive = np.flatnonzero((lengths >= self.shortest) & (lengths <= self.longest))
        state = np.full(len(alive), self.start, dtype=np.int32)
        place = 0
        while len(alive):
            ended = lengths[alive] == place
            if ended.any():
                out[alive[ended]] = self.distance[state[ended]]
                alive, state = alive[~ended], state[~ended]
            if not len(alive):
                break
            code = codes[starts[alive] + place]
            char = np.where(code < len(self.code_class), self.code_class[np.minimum(code, len(self.code_class) - 1)], 0)
            following = self.table[state, char]
            unknown = following < 0
            if unknown.any():
                for pair in np.unique(state[unknown].astype(np.int64) * self.classes + char[unknown]):
                    s, c = divmod(int(pair), self.classes)
                    target = self._advance(s, c)
                    self.table[s, c] = target
                following = self.table[state, char]
            on = following != self.dead
            alive, state = alive[on], following[on]
            place += 1
        return out


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    bias: float
    automaton: LexiconAutomaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "bias": self.bias, "automaton": None}

    def ready(self) -> LexiconAutomaton:
        if self.automaton is None:
            self.automaton = LexiconAutomaton(self.terms)
        return self.automaton


_QUOTE_CODES = np.array(sorted(ord(c) for c in QUOTES), dtype=np.uint32)


def features(automaton: LexiconAutomaton, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """1 - 4^-hits by edits (0, 1, 2) outside quotation, then inside, for every row of a piece.

    A hit is inside quotation if a quotation mark stands among the ``window`` words before it and another among those
    after it.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES))
    if not len(data):
        return out
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    small = codes < len(_LOWER)
    near = np.minimum(codes, len(_LOWER) - 1)
    codes = np.where(small, _LOWER[near], codes)
    inside = np.where(small, _IS_WORD[near], True)
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[edges] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1
    distance = automaton.distances(codes, starts, ends - starts)
    hits = np.flatnonzero(distance < 9)
    if not len(hits):
        return out
    row = np.searchsorted(edges, starts[hits], side="right") - 1
    first, last = np.searchsorted(starts, edges[:-1])[row], np.searchsorted(starts, edges[1:])[row] - 1
    left, right = starts[np.maximum(hits - window, first)], ends[np.minimum(hits + window, last)]
    # The marks around the outermost words of the window belong to it.
    left, right = np.maximum(left - 1, edges[row]), np.minimum(right + 1, edges[row + 1])
    marks = np.flatnonzero(np.isin(codes, _QUOTE_CODES))
    count = lambda a, b: np.searchsorted(marks, b) - np.searchsorted(marks, a)
    quoted = (count(left, starts[hits]) > 0) & (count(ends[hits], right) > 0)
    np.add.at(out, (row, distance[hits] + 3 * quoted), 1.0)
    return 1.0 - 0.25**out


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights of a regression held near the prior by ``pull`` (damped Newton steps)."""
    prior = np.r_[PRIOR, PRIOR_BIAS]
    w = prior.copy()
    design = np.c_[x, np.ones(len(x))]

    def loss(v):
        z = design @ v
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * pull * ((v - prior) ** 2).sum()

    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + pull * (w - prior)
        curve = (design * (p * (1 - p))[:, None]).T @ design + pull * np.eye(len(w))
        step, at = np.linalg.solve(curve, slope), 1.0
        while at > 1e-4 and loss(w - at * step) > loss(w):
            at /= 2
        w = w - at * step
        if np.abs(at * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _counted(batches):
    """Documents of either label that hold a word, counted over a batch."""
    for batch in batches:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            own = counts[1 if toxic else 0]
            for w in set(_words(text.as_py())):
                own[w] = own.get(w, 0) + 1
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch(
            [pa.array(words, pa.string()), pa.array([counts[1].get(w, 0) for w in words], pa.int64()),
             pa.array([counts[0].get(w, 0) for w in words], pa.int64())],
            names=["word", "toxic", "clean"],
        )


def _contexts(held):
    def run(batches):
        wanted = held.value
        for batch in batches:
            found = set()
            for text in batch.column("text"):
                words = _words(text.as_py())
                for i, w in enumerate(words):
                    if w in wanted:
                        found.add((w, " ".join([*words[max(0, i - 1) : i], "_", *words[i + 1 : i + 2]])))
            yield pa.record_batch(
                [pa.array([w for w, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())],
                names=["word", "context"],
            )

    return lean(run)


def _featured(held):
    def run(batches):
        automaton = held.value.ready()
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text")):
                found = features(automaton, data, offsets)
                yield pa.record_batch(
                    [batch.column("toxic").slice(row, end - row), pa.array(list(found), pa.list_(pa.float64()))],
                    names=["toxic", "x"],
                )

    return lean(run)


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Lexicon and weights from at most ``rows`` labelled documents, those with the smallest hashes of their ids.

    Seven tenths of the sample teach the lexicon (at most MAX_TERMS terms), the rest the weights. Rows without a label
    or an id teach nothing; without any labels the lexicon is empty and the prior weights stay.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col("doc_id"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("h", h).orderBy("h").limit(rows).select("doc_id", "toxic", (F.pmod("h", F.lit(10)) < 7).alias("teach"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = base.join(F.broadcast(chosen), "doc_id")
    lessons = sample.where("teach").select("text", "toxic")
    counts = written(
        lessons.mapInArrow(lean(_counted), "word string, toxic long, clean long").groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    share = lessons.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("q")).first()["q"] or 0.0
    frequent = (
        counts.where((F.col("toxic") >= documents_needed(share, counts.count())) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("clean"))) & (F.length("word") > 2))
        .orderBy(F.desc("toxic"), "word").limit(4 * MAX_TERMS)
    )
    held = spark.sparkContext.broadcast({r["word"] for r in frequent.collect()})
    varied = (
        lessons.where("toxic > 0").mapInArrow(_contexts(held), "word string, context string").distinct()
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_CONTEXTS)
        .orderBy(F.desc("n"), "word").limit(MAX_TERMS)
    )
    model = ToxicityModel(sorted(r["word"] for r in varied.collect()), PRIOR.copy(), PRIOR_BIAS)
    got = sample.where("not teach").select("text", "toxic").mapInArrow(
        _featured(spark.sparkContext.broadcast(model)), "toxic int, x array<double>"
    ).collect()
    if got:
        order = sorted((r["toxic"], r["x"]) for r in got)
        model.weights, model.bias = logistic(np.array([x for _, x in order]), np.array([float(t > 0) for t, _ in order]))
    return model


def _scorer(held):
    def run(batches):
        model = held.value
        automaton = model.ready()
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text")):
                z = features(automaton, data, offsets) @ model.weights + model.bias
                yield pa.record_batch(
                    [batch.column("doc_id").slice(row, end - row), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))],
                    names=["doc_id", "score"],
                )

    return lean(run)


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of the toxic label) of every whole text.

    Null and empty texts have no hits and get the score of the bias alone; equal texts get equal scores. Only the two
    named columns are read; rows that repeat a doc_id are scored one by one. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_scorer(held), "doc_id long, score double")
