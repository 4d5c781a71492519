"""Attaching one row per group to the group's members, whatever the group's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SIEVE_WORDS = 1 << 18


def sifted(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``; none that is goes missing, and an exact join must follow.

    The keys become marks in one array of bits, sixteen for each of ``expected`` keys and SIEVE_WORDS words at most, which is
    all that is broadcast.  So rows are dropped where they are read, before they are shuffled for the join.
    """
    words = 1 << max(6, min(SIEVE_WORDS, expected // 4 + 1).bit_length())
    place = F.pmod(F.xxhash64(*keys), F.lit(64 * words))
    marks = wanted.select(F.floor(place / 64).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("_mark"))
    held = marks.groupBy("_word").agg(F.bit_or("_mark").alias("_mark"))
    every = rows.sparkSession.range(words).select(F.col("id").alias("_word")).join(F.broadcast(held), "_word", "left")
    filled = every.agg(F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_mark", F.lit(0).cast("bigint")).alias("_mark")))).alias("_all"))
    bits = filled.select(F.col("_all._mark").alias("_bits"))
    word = F.get("_bits", F.floor(place / 64).cast("int"))
    kept = rows.crossJoin(F.broadcast(bits)).where(
        F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return kept.select(rows.columns)


def attach(
    rows: DataFrame, per_group: DataFrame, keys: Sequence[str], bounded: bool = False, how: str = "inner"
) -> DataFrame:
    """Join ``per_group`` (at most one row per key) onto ``rows``.

    Without keys it is a single row and is broadcast.  ``bounded`` states that the number of groups is limited
    by a parameter, which also allows a broadcast.  Otherwise it is an equi-join whose hot groups adaptive execution
    splits by their measured size.  It can do so only if both sides are shuffled for the join, so a ``per_group`` that
    comes out of an aggregate is dealt anew.
    """
    keys = list(keys)
    if not keys:
        return rows.join(F.broadcast(per_group), how=how) if how != "inner" else rows.crossJoin(F.broadcast(per_group))
    return rows.join(F.broadcast(per_group) if bounded else per_group.hint("rebalance"), keys, how)
