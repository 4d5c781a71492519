"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's features are its character n-grams (bytes, lower-cased A-Z), hashed into a fixed table of embeddings. Their
average goes through one linear layer and a softmax; embeddings and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature fitted on rows of the sample that the training
did not see calibrates the probabilities.

A softmax is sure of texts unlike any it has seen, so rejection has columns of its own in the averaged table: how common an
n-gram is in each language of the sample. A text is rejected if it has no letter, if its calibrated confidence is below a
threshold, or if its n-grams are common in no language. That last threshold lies between the calibration rows and rows of
unknown language: the same rows, seen with the columns of the other languages alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, pack, text_slices, unpack

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
DIMENSION = 16
SAMPLE_ROWS = 3000
EPOCHS = 6
KEPT_SHARE = 0.999
COMMON_SHARE = 0.995
UNKNOWN_SHARE = 0.95
MARGIN = 0.5
RARE = 1e-6  # share of n-grams below which all are alike
SLACK = 6.0  # allowance over the square root of a text's n-grams
NO_LANGUAGE = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Class names, the embedding table times the layer (buckets x classes, and again classes: how common a bucket is), bias,
    temperature, and the thresholds of confidence and commonness."""

    names: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    least_common: float = -np.inf


def _fold() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint32)
    codes[65:91] += 32
    codes[[9, 10, 11, 12, 13]] = 32
    return codes


_CODES = _fold()


def ngram_buckets(data: np.ndarray, size: int, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of data[i : i + size] for every i (a fixed multiplicative hash of up to three bytes)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    folded = _CODES[data]
    key = np.full(n, size, dtype=np.uint32)
    for k in range(size):
        key <<= np.uint32(8)
        key |= folded[k : k + n]
    key *= np.uint32(0x9E3779B1)
    return key >> np.uint32(32 - (buckets.bit_length() - 1))


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram size, buckets over the whole buffer and which of them lie inside one row."""
    edges, valid = np.asarray(offsets), []
    grams = [ngram_buckets(data, size) for size in SIZES]
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for size, own in zip(SIZES, grams):
        valid.append(row[: len(own)] == row[size - 1 : size - 1 + len(own)])
    return grams, valid


def row_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares of its n-grams."""
    grams = np.concatenate([ngram_buckets(data, size) for size in SIZES])
    found, counts = np.unique(grams, return_counts=True)
    return found.astype(np.uint16), (counts / max(1, counts.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel | None:
    """Fit the embeddings and the layer to rows of features; None without any."""
    names = tuple(sorted(set(labels)))
    if not names:
        return None
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer = np.zeros((DIMENSION, len(names)), dtype=np.float32)
    layer += rng.normal(0, 0.3, layer.shape)
    bias = np.zeros(len(names), dtype=np.float32)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    order = np.flatnonzero(~held)
    # Rare classes weigh as much as common ones.
    weight = len(order) / (len(names) * np.maximum(1, np.bincount(y[order], minlength=len(names))))
    step = 2.0
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            found, share = rows[i]
            if not len(found):
                continue
            mean = share @ embed[found]
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            p *= min(weight[y[i]], 4.0) * step
            back = layer @ p
            layer -= np.outer(mean, p)
            bias -= 0.05 * p
            embed[found] -= np.outer(share, np.clip(back, -5, 5))
        step *= 0.6
    table = (embed @ layer).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else order
    logits = np.array([share @ table[found] + bias for found, share in (rows[i] for i in test)]).reshape(-1, len(names))
    temperature = _temperature(logits, y[test])
    p = _softmax(logits / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[test]])
    # The confidence that all but a thousandth of the rightly labelled calibration rows exceed, with a margin.
    threshold = 0.5 * float(right[int((1 - KEPT_SHARE) * len(right))]) if len(right) else 0.0
    common = np.column_stack([_commonness(rows, order[y[order] == k]) for k in range(len(names))])
    least = _least_common(rows, y, test, common)
    return LanguageModel(names, np.column_stack([table, common]).astype(np.float32), bias, temperature, threshold, least)


def _commonness(rows: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray) -> np.ndarray:
    """Log of each bucket's mean share over the chosen rows."""
    total = np.zeros(BUCKETS)
    for i in chosen:
        found, share = rows[i]
        total[found] += share
    return np.log(total / max(1, len(chosen)) + RARE).astype(np.float32)


def _least_common(rows, y: np.ndarray, test: np.ndarray, common: np.ndarray) -> float:
    """Between what COMMON_SHARE of the calibration rows reach and what UNKNOWN_SHARE do not, each seen without its language."""
    mean, allowance = np.zeros((len(test), common.shape[1])), np.zeros(len(test))
    for at, i in enumerate(test):
        found, share = rows[i]
        if len(found):
            mean[at] = share @ common[found]
            # The rarest bucket of a text occurs once in nearly all of them, so its share tells the number of n-grams.
            allowance[at] = SLACK * np.sqrt(share.min())
    if not len(test):
        return -np.inf
    low = np.quantile(mean.max(axis=1) + allowance, 1 - COMMON_SHARE)
    if common.shape[1] < 2:
        return float(low - 1.0)
    mean[np.arange(len(test)), y[test]] = -np.inf
    high = np.quantile(mean.max(axis=1) + allowance, UNKNOWN_SHARE)
    return float(low - MARGIN * max(low - high, 0.0))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows kept from training."""
    if not len(y):
        return 1.0
    tried = np.geomspace(0.02, 8.0, 61)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def _features(batches):
    for batch in batches:
        packed = []
        for _, _, data, offsets in text_slices(batch.column("text")):
            packed += [pack(*row_features(data[offsets[i] : offsets[i + 1]])) for i in range(len(offsets) - 1)]
        yield pa.record_batch([batch.column("lang"), pa.array(packed, pa.binary())], names=["lang", "features"])


def fit(
    docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel | None:
    """A model of the languages of ``docs``, from the ``rows`` labelled rows with the smallest hashes of id and text.

    The bound is of the training sample alone. Its whole texts are turned into features, at most BUCKETS numbers a
    row, where they lie, and only those reach the driver.
    """
    text = F.col(text_col).cast("string")
    eligible = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.xxhash64(F.col(id_col), F.crc32(text.cast("binary"))).alias("h"), text.alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    cut = eligible.select("h").orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    if cut is None:
        return None
    found = eligible.where(F.col("h") <= cut).select("lang", "text").mapInArrow(lean(_features), "lang string, features binary")
    sample = sorted((r["lang"], bytes(r["features"])) for r in found.collect())
    np.random.default_rng(3).shuffle(sample)
    return train([tuple(unpack(f, np.uint16, np.float32)) for _, f in sample], [str(x) for x, _ in sample])


def scores(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated class probabilities of every row of a piece, and whether its n-grams are common enough."""
    rows, classes = len(offsets) - 1, len(model.names)
    total = np.zeros((rows, 2 * classes))
    count = np.zeros(rows)
    grams, valid = text_features(data, offsets)
    some = np.diff(offsets) > 0
    for own, ok in zip(grams, valid):
        if not len(own):
            continue
        value = model.table[own]
        value[~ok] = 0
        starts = np.minimum(offsets[:-1][some], len(own) - 1)
        inside = np.add.reduceat(value, starts, axis=0, dtype=np.float64)
        number = np.add.reduceat(ok, starts, dtype=np.int64)
        # A row that begins after the last gram has none of this size.
        late = offsets[:-1][some] >= len(own)
        inside[late], number[late] = 0, 0
        total[some] += inside
        count[some] += number
    mean = total / np.maximum(count, 1)[:, None]
    common = mean[:, classes:].max(axis=1) + SLACK / np.sqrt(np.maximum(count, 1))
    return _softmax((mean[:, :classes] + model.bias) / model.temperature), common >= model.least_common


def _predictor(held):
    def run(batches):
        model = held.value
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in text_slices(batch.column("text")):
                own = letters[row:end].astype(bool)
                if model is None:
                    names = [NO_LANGUAGE] * (end - row)
                    score = np.zeros(end - row)
                    rejected = ~own
                else:
                    p, common = scores(model, data, offsets)
                    best = p.argmax(axis=1)
                    score = np.where(own, p.max(axis=1), 0.0)
                    names = [model.names[b] if k else NO_LANGUAGE for b, k in zip(best, own)]
                    rejected = ~own | (score < model.threshold) | ~common
                yield pa.record_batch(
                    [batch.column("doc_id").slice(row, end - row), pa.array(names, pa.string()),
                     pa.array(score), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return lean(run)


def identified(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability of lang_pred), rejected, for every whole text.

    Texts that are null or have no letter are ``und`` with score 0 and rejected. Without a model, that is without a
    labelled row to learn from, every text is ``und`` with score 0, and only those without a letter are rejected. Texts that repeat get equal results; ties between classes go to the
    first in order of name. Only the two named columns are read. The model's size is fixed: BUCKETS rows of one
    number for each language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return base.mapInArrow(_predictor(held), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    lettered = docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        known = held.value
        for batch in batches:
            if known is None:
                yield batch
                continue
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            kept = []
            for _, _, data, offsets in text_slices(column):
                p, common = scores(known, data, offsets)
                kept.append((p.max(axis=1) >= known.threshold) & common)
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return lettered.mapInArrow(lean(run), docs.schema)
