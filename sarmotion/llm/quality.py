"""Quality by regularised quadratic discriminant analysis over transformed statistics of whole texts.

Every text becomes one short vector (shares as arcsine roots, counts as logarithms). Each class has a mean and a
covariance, which is shrunk towards the pooled one and towards its diagonal. A score is the difference of two Gaussian
log densities, each a Mahalanobis distance through a Cholesky factor that is made once and kept, damped and put
through the logistic function with the classes' shares.

Moments are sums, so all labelled rows teach; nothing but sums over rows reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, mix64, row_of, span_hashes, text_slices, word_bounds, written

FOLDS = 5
TOWARDS_POOLED = (0.0, 0.1, 0.3, 0.6, 1.0)
TOWARDS_DIAGONAL = (0.01, 0.1, 0.3)
DAMPING = (1.0, 0.5, 0.25, 0.12, 0.06)
FLOOR = 1e-6

STATISTICS = (
    "log_words", "word_length", "word_spread", "upper", "digit", "symbol", "sentence_end", "wide", "space", "line_break",
    "byte_entropy", "distinct", "commonest", "word_again", "byte_again", "short_words",
)

_CLASSES = ("upper", "lower", "digit", "symbol", "sentence_end", "wide", "space", "line_break")


def _membership() -> np.ndarray:
    """256 x classes: what kind of character each byte is; of a wide character its first byte counts."""
    table = np.zeros((256, len(_CLASSES)))
    for byte in range(256):
        c = chr(byte)
        kind = (
            "line_break" if c == "\n" else "space" if c in " \t\r\x0b\x0c" else "sentence_end" if c in ".!?"
            else "wide" if byte >= 0xC0 else None if byte >= 0x80
            else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "symbol"
        )
        if kind:
            table[byte, _CLASSES.index(kind)] = 1.0
    return table


_MEMBERSHIP = _membership()


def _root(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1.0), 0.0, 1.0)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x STATISTICS for every text of a piece; an empty text has zeros throughout."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    of_byte = np.repeat(np.arange(rows), size)
    counts = np.bincount(of_byte * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    kind = dict(zip(_CLASSES, (counts @ _MEMBERSHIP).T))
    chars = sum(kind.values())
    letters = kind["upper"] + kind["lower"] + kind["wide"]
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)

    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    mean = _sums(length, first) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(_sums(length**2, first) / np.maximum(words, 1) - mean**2, 0.0))
    of_word = row_of(first)
    named = span_hashes(data, starts, ends, lower=True)
    again = np.zeros(len(named))
    again[1:] = (named[1:] == named[:-1]) & (of_word[1:] == of_word[:-1])
    keyed = mix64(named ^ mix64(of_word.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed)
    keyed = keyed[order]
    edge = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]]) if len(keyed) else np.zeros(0, np.int64)
    times, owner = np.diff(np.r_[edge, len(keyed)]), of_word[order[edge]]
    distinct = np.bincount(owner, minlength=rows).astype(np.float64)
    commonest = np.zeros(rows)
    np.maximum.at(commonest, owner, times)
    same = np.zeros(len(data))
    same[1:] = (data[1:] == data[:-1]) & (of_byte[1:] == of_byte[:-1])
    columns = {
        "log_words": np.log1p(words), "word_length": np.log1p(mean), "word_spread": np.log1p(spread),
        "upper": _root(kind["upper"], letters), "digit": _root(kind["digit"], chars), "symbol": _root(kind["symbol"], chars),
        "sentence_end": _root(kind["sentence_end"], words), "wide": _root(kind["wide"], letters),
        "space": _root(kind["space"], chars), "line_break": _root(kind["line_break"], chars), "byte_entropy": entropy,
        "distinct": np.log1p(distinct) / np.maximum(np.log1p(words), FLOOR), "commonest": _root(commonest, words),
        "word_again": _root(_sums(again, first), words), "byte_again": _root(_sums(same, offsets), size),
        "short_words": _root(_sums(length <= 3, first), words),
    }
    return np.column_stack([columns[name] for name in STATISTICS])


@dataclass(frozen=True)
class QualityModel:
    """Means, inverse Cholesky factors and log determinants of the two classes; without factors a constant score."""

    prior: float
    damping: float = 1.0
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    logdets: tuple[float, float] | None = None
    pooled: float = 1.0
    diagonal: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 minus that under class 0."""
        if self.factors is None:
            return np.zeros(len(x))
        density = [
            -0.5 * ((((x - mean) @ factor.T) ** 2).sum(axis=1) + logdet)
            for mean, factor, logdet in zip(self.means, self.factors, self.logdets)
        ]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _probability(self.damping * self.log_ratio(x), self.prior)


def _probability(ratio: np.ndarray, prior: float) -> np.ndarray:
    z = ratio + np.log(prior) - np.log1p(-prior)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class Moments:
    """Count, sum and sum of outer products of each class."""

    def __init__(self, width: int = len(STATISTICS)):
        self.n, self.s, self.q = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for k in (0, 1):
            own = x[y == k]
            self.n[k] += len(own)
            self.s[k] += own.sum(axis=0)
            self.q[k] += own.T @ own

    def flat(self) -> np.ndarray:
        return np.concatenate([self.n, self.s.ravel(), self.q.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, width: int = len(STATISTICS)) -> Moments:
        out = cls(width)
        out.n, out.s = flat[:2].copy(), flat[2 : 2 + 2 * width].reshape(2, width).copy()
        out.q = flat[2 + 2 * width :].reshape(2, width, width).copy()
        return out

    def model(self, pooled: float, diagonal: float, damping: float = 1.0) -> QualityModel:
        """Each class covariance moved by ``pooled`` towards the common one, then by ``diagonal`` towards its diagonal.

        A class without rows leaves a model whose only evidence is the smoothed share of the classes.
        """
        prior = float((self.n[1] + 1.0) / (self.n.sum() + 2.0))
        if not self.n.all():
            return QualityModel(prior)
        means = [self.s[k] / self.n[k] for k in (0, 1)]
        scatter = [self.q[k] - self.n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        common = (scatter[0] + scatter[1]) / self.n.sum()
        factors, logdets = [], []
        for k in (0, 1):
            own = (1 - pooled) * scatter[k] / self.n[k] + pooled * common
            own = (1 - diagonal) * own + diagonal * np.diag(np.diag(common)) + FLOOR * np.eye(len(common))
            lower = np.linalg.cholesky((own + own.T) / 2)
            factors.append(np.linalg.inv(lower))
            logdets.append(float(2 * np.log(np.diag(lower)).sum()))
        return QualityModel(prior, damping, tuple(means), tuple(factors), tuple(logdets), pooled, diagonal)


def _described(batches):
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column("text")):
            yield pa.record_batch(
                [batch.column("doc_id").slice(row, end - row), pa.array(list(statistics(data, offsets)), pa.list_(pa.float64()))],
                names=["doc_id", "x"],
            )


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics ``x`` of every row; a null text is an empty one."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(lean(_described), "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _moments(batches):
    folds = [Moments() for _ in range(FOLDS)]
    for batch in batches:
        x, y, fold = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for f in np.unique(fold):
            folds[f].add(x[fold == f], y[fold == f])
    flat = np.stack([m.flat() for m in folds])
    fold, place = np.nonzero(flat)
    yield pa.record_batch(
        [pa.array(fold.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(flat[fold, place])],
        names=["fold", "place", "value"],
    )


def _trial_losses(held):
    def run(batches):
        trials = held.value
        loss = np.zeros((len(trials[0]), len(DAMPING)))
        for batch in batches:
            x, y, fold = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                own, label = x[fold == f], y[fold == f]
                for i, model in enumerate(trials[f]):
                    ratio = model.log_ratio(own)
                    for j, damping in enumerate(DAMPING):
                        p = np.clip(_probability(damping * ratio, model.prior), 1e-12, 1 - 1e-12)
                        loss[i, j] -= np.log(np.where(label == 1, p, 1 - p)).sum()
        i, j = np.indices(loss.shape)
        yield pa.record_batch(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(loss.ravel())],
            names=["trial", "damping", "loss"],
        )

    return run


def fit(described_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """The discriminant of all labelled rows; both shrinkages and the damping have the least cross-validated log loss.

    Rows without an id or a label teach nothing; of repeated labels the largest counts; any label above 0 is class 1.
    What reaches the driver is FOLDS sets of moments and one loss for each trial.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y"))
        .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    lessons = described_docs.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    sums = lessons.mapInArrow(_moments, "fold int, place int, value double").groupBy("fold", "place").agg(F.sum("value").alias("value"))
    width = len(STATISTICS)
    flat = np.zeros((FOLDS, 2 + 2 * width + 2 * width * width))
    for r in sums.collect():
        flat[r["fold"], r["place"]] = r["value"]
    whole = Moments.of(flat.sum(axis=0))
    if not whole.n.all():
        return whole.model(1.0, 0.0)
    grid = [(p, d) for p in TOWARDS_POOLED for d in TOWARDS_DIAGONAL]
    trials = [[Moments.of(flat.sum(axis=0) - flat[f]).model(*g) for g in grid] for f in range(FOLDS)]
    held = described_docs.sparkSession.sparkContext.broadcast(trials)
    losses = (
        lessons.mapInArrow(_trial_losses(held), "trial int, damping int, loss double")
        .groupBy("trial", "damping").agg(F.sum("loss").alias("loss")).collect()
    )
    best = min(losses, key=lambda r: (r["loss"], r["trial"], r["damping"]))
    return whole.model(*grid[best["trial"]], DAMPING[best["damping"]])


def _scorer(held):
    def run(batches):
        model = held.value
        for batch in batches:
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"]
            )

    return run


def scored(described_docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (probability of class 1) of every described row."""
    held = described_docs.sparkSession.sparkContext.broadcast(model)
    return described_docs.mapInArrow(_scorer(held), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id and the score of every whole text, learnt from ``labels``.

    The statistics are written once and read by the fit and by the scoring. Only the named columns are read. Null and
    empty texts have zeros for statistics and are scored like any other; equal texts get equal scores; rows that
    repeat a doc_id or have none are scored one by one. Without labels of both classes every score is the smoothed share
    of class 1 (a half without labels). An empty table gives an empty result.
    """
    found = written(described(docs, id_col, text_col))
    return scored(found, fit(found, labels, id_col, label_col))
