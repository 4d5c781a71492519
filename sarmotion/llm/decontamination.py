"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark items.

Texts become lower-cased words (A-Z; words are runs of digits, letters a-z and non-ASCII characters). A window is 13
consecutive item words, or the whole of a shorter item. Every window of 13 holds one of its item's aligned blocks of seven
words, so those blocks (and the short items) are the automaton's patterns over word numbers: it has about one node for each
benchmark word, not thirteen. A document's words are read once; every hit of a block is extended both ways along its
item, and a stretch of 13 or more is a union of windows. Word places are mapped back to code points of the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, total_text_bytes, written

WINDOW = 13
AUTOMATON_BYTES = 8 << 20
ALPHABET = "".join(chr(48 + i) for i in range(64))

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BUILT: dict[int, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def _spans(text: str) -> list[tuple[int, int]]:
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return [m.span() for m in _WORD.finditer(lowered)]


def _code(n: int, letters: int) -> str:
    out = []
    for _ in range(letters):
        n, at = divmod(n, len(ALPHABET))
        out.append(ALPHABET[at])
    return "".join(out)


class Automaton:
    """Blocks of the items' words, and the items themselves to extend a hit along."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        import ahocorasick

        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        self.items: list[np.ndarray] = []
        size = (window + 1) // 2
        patterns: dict[tuple, list[tuple[int, int]]] = {}
        for item_id, text in dict.fromkeys(items):
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not seq:
                continue
            owner = len(self.ids)
            self.ids.append(item_id)
            self.items.append(np.array(seq, dtype=np.uint32))
            if len(seq) < window:
                patterns.setdefault(tuple(seq), []).append((owner, 0))
            else:
                for at in range(0, len(seq) - size + 1, size):
                    patterns.setdefault(tuple(seq[at : at + size]), []).append((owner, at))
        self.usable = bool(patterns)
        # A word number is written as letters of a small alphabet, as many for each word, so no node has many children.
        self.letters = 1
        while len(ALPHABET) ** self.letters <= len(self.numbers):
            self.letters += 1
        self.codes = [_code(n, self.letters) for n in range(len(self.numbers) + 1)]
        self.blocks = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        while patterns:
            pattern, places = patterns.popitem()
            self.blocks.add_word("".join([self.codes[n] for n in pattern]), (len(pattern), places))
        if self.usable:
            self.blocks.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, merged hit ranges of words, and the ids of the items that occur."""
        words = words_of(text)
        if not self.usable or not words:
            return len(words), [], set()
        get = self.numbers.get
        seq = [get(w, 0) for w in words]
        codes, letters = self.codes, self.letters
        own, found, ranges = None, set(), []
        done: dict[tuple[int, int], int] = {}  # (item, shift against the text) -> end of the stretch that is known
        for end, (size, places) in self.blocks.iter("".join([codes[n] for n in seq])):
            if (end + 1) % letters:  # begins inside a word
                continue
            start = (end + 1) // letters - size
            for owner, at in places:
                item = self.items[owner]
                shift = start - at
                if done.get((owner, shift), -1) > start:
                    continue
                if own is None:
                    own = np.array(seq, dtype=np.uint32)
                low, high = _stretch(own, item, start, at, size)
                done[owner, shift] = high
                if high - low >= min(self.window, len(item)):
                    ranges.append((low, high))
                    if self.ids[owner] is not None:
                        found.add(self.ids[owner])
        return len(words), _union(ranges), found


def _stretch(text: np.ndarray, item: np.ndarray, start: int, at: int, size: int) -> tuple[int, int]:
    """The words of the text round ``start`` that equal the item's round ``at``."""
    back = min(start, at)
    apart = np.flatnonzero(text[start - back : start] != item[at - back : at])
    low = start - back + (int(apart[-1]) + 1 if len(apart) else 0)
    on = min(len(text) - start - size, len(item) - at - size)
    apart = np.flatnonzero(text[start + size : start + size + on] != item[at + size : at + size + on])
    return low, start + size + (int(apart[0]) if len(apart) else on)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and out[-1][1] >= low:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


RESULT = "doc_id long, n_words long, hits array<struct<word:long,words:long,start:long,end:long>>, items array<string>"
_HIT = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _mapper(items, keys=("doc_id",)):
    def run(batches):
        key = id(items)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = (items, Automaton(items.value))
        automaton = _BUILT[key][1]
        for batch in batches:
            counts, hits, owners = [], [], []
            for scalar in batch.column("text"):
                text = scalar.as_py()
                n, ranges, found = automaton.scan(text)
                places = _spans(text) if ranges else []
                counts.append(n)
                owners.append(sorted(found))
                hits.append([{"word": s, "words": e - s, "start": places[s][0], "end": places[e - 1][1]} for s, e in ranges])
            yield pa.record_batch(
                [batch.column(k) for k in keys] + [
                    pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HIT)), pa.array(owners, pa.list_(pa.string()))],
                names=[*keys, "n_words", "hits", "items"],
            )

    return lean(run)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """doc_id, n_words, hits (ranges of words and their code points in the text), items (ids, sorted as strings).

    The benchmark is dealt by item into blocks of about ``block_bytes`` of text (its size is measured), each block
    being one automaton; with one block the documents are read once. No more than a block is on the driver or broadcast at a
    time: with several, each block's hits are written before the next is taken. Null or empty texts have no words and no
    hits; items without words are no patterns; items without an id mark words but are not named; repeated items count
    once. Rows that repeat a doc_id, and rows
    without one, are judged one by one: beyond one block the rows are written with a number of their own. Empty tables are allowed on either side.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    blocks = max(1, -(-total_text_bytes(items) // block_bytes))
    keys = ("doc_id",)
    if blocks > 1:
        base, keys = written(base.withColumn("row", F.monotonically_increasing_id())), ("row", "doc_id")
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])
        if blocks == 1:
            return base.mapInArrow(_mapper(held, keys), RESULT)
        found = base.mapInArrow(_mapper(held, keys), "row long, " + RESULT)
        # Rows of later blocks are needed only where there are hits.
        parts.append(written(found if block == 0 else found.where("size(hits) > 0")))
        held.unpersist()
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).select("doc_id", "n_words", _merged("hits").alias("hits"), "items")


def _merged(column: str):
    """Sorted ranges with overlapping or touching neighbours joined."""
    last = lambda acc: F.element_at(acc, -1)
    end = lambda h: h["word"] + h["words"]
    kind = "array<struct<word:bigint,words:bigint,start:bigint,end:bigint>>"
    join = lambda acc, h: F.when(
        (F.size(acc) > 0) & (end(last(acc)) >= h["word"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(
                last(acc)["word"].alias("word"),
                (F.greatest(end(last(acc)), end(h)) - last(acc)["word"]).alias("words"),
                last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], h["end"]).alias("end"),
            )),
        ),
    ).otherwise(F.concat(acc, F.array(h)))
    return F.aggregate(column, F.array().cast(kind), join)


def hit_words(hits="hits"):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["words"])


def contaminated(n_hit, n_words):
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
