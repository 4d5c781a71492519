"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of the parts of the table find the digests that may be frequent. Their exact counts are
verified, and the winners, at most ``COUNTERS`` rows by the summary's guarantee, are broadcast: rows of frequent
texts are decided where they lie. Every other group has fewer than ``2 / COUNTERS`` of all rows and is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, SPACES, written

COUNTERS = 1024


def without_spaces(text: Column) -> Column:
    for code in SPACES:
        text = F.replace(text, F.lit(chr(code)), F.lit(""))
    return text


def _misra_gries(counters: int):
    """Counters of one part of the table; each is too low by at most rows / (counters + 1)."""

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            for value, count in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                held[value] = held.get(value, 0) + count
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {v: c - cut for v, c in held.items() if c > cut}
        if held:
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                  names=["text_sha256", "least"])

    return lean(run)


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that surely reach 1 / counters of the rows: at most ``counters`` rows, none above twice that missing."""
    rows = digests.count()
    return (
        digests.select("text_sha256").mapInArrow(_misra_gries(counters), "text_sha256 string, least long")
        .groupBy("text_sha256").agg(F.sum("least").alias("least"))
        .where(F.col("least") * counters >= rows).where("least > 1").select("text_sha256")
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space ([\\x20\\x09-\\x0D]); null counts as empty, and all
    empty texts are one group. The longest original (in code points) stays, then the smallest doc_id; a null
    doc_id stays only in a group without others. Rows that repeat a doc_id and a text are counted one by one, and
    those of the keeper's doc_id are all marked kept. Only the two named columns are read. An empty table gives
    an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (-F.char_length(text)).alias("shorter"),
        F.sha2(without_spaces(text).cast("binary"), 256).alias("text_sha256"),
    ))
    best = F.min(F.struct("shorter", F.col("doc_id").isNull().alias("missing"), "doc_id"))
    heavy = written(
        digests.join(F.broadcast(frequent_digests(digests, counters)), "text_sha256")
        .groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    group = Window.partitionBy("text_sha256")
    light = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti").withColumns({
        "best": best.over(group), "group_size": F.count(F.lit(1)).over(group),
    })
    fields = ["doc_id", "best", "group_size", "text_sha256"]
    both = digests.join(F.broadcast(heavy), "text_sha256").select(fields).unionByName(light.select(fields))
    return both.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), "text_sha256",
    )
