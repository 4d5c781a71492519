"""Exact order statistics without a global sort: radix selection.

A double is mapped to a 64-bit integer of the same order.  Equal values of a group are counted once and shuffled;
everything else works on that compact column, which Spark computes once and reads again from its shuffle.  Three digits
follow, high to low: a histogram of the digit within what earlier digits have left, for all groups and ranks at once,
tells which of its bins holds each rank.  After the last digit a bin is one value, so the answer is exact.  Histograms are
sums, so they merge on the map side; a task never orders more than the bins of one digit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach

# Bits below each digit; the first digit has the sign, the exponent and eight bits of the fraction.
SHIFTS = (44, 22, 0)
MASK = (1 << 22) - 1
_FRACTION = 1 << 52
_SMALLEST_NORMAL = 2.0**-1022
_SMALLEST = 2.0**-1074


@dataclass(frozen=True)
class Rank:
    """A 0-based rank as an expression over the group size ``n``."""

    share: float
    rank: Column


def by_index(share: float) -> Rank:
    """The value at index ``floor((n - 1) * share)`` of the sorted column."""
    return Rank(share, F.floor((F.col("n") - 1).cast("double") * share))


def medians() -> dict[str, Rank]:
    """The two middle values; equal for an odd count."""
    n = F.col("n")
    return {
        "mid_lo": Rank(0.5, F.floor((n - 1) / 2)),
        "mid_hi": Rank(0.5, F.floor(n / 2)),
    }


def with_ordered_bits(df: DataFrame, value: str, into: str) -> DataFrame:
    """Add the exponent and fraction of a double as one integer that orders like it.

    NaN is the largest and zeros are equal.  Scaling by powers of two is exact, so nothing is rounded.
    """
    v, size, power = F.col(value), F.abs(F.col(value)), F.pow(F.lit(2.0), F.col("_e"))
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("double")
    # The logarithm may round across a power of two.
    step = F.when(size < power, -1.0).when(size / power >= 2.0, 1.0).otherwise(0.0)
    fraction = ((size / power - 1.0) * float(_FRACTION)).cast("bigint")
    code = (
        F.when(size < _SMALLEST_NORMAL, (size / _SMALLEST).cast("bigint"))
        .when(size == float("inf"), F.lit(2047 * _FRACTION))
        .when(F.isnan(v), F.lit(2047 * _FRACTION + 1))
        .otherwise((F.col("_e") + 1023).cast("bigint") * _FRACTION + fraction)
    )
    return (
        df.withColumn("_e", guess).withColumn("_e", F.col("_e") + step).withColumn(into, code)
        .withColumn(into, F.coalesce(F.when(v < 0, -F.col(into)).otherwise(F.col(into)), F.lit(0).cast("bigint"))).drop("_e")
    )


def from_bits(bits: Column) -> Column:
    """The double that ``with_ordered_bits`` maps to ``bits``."""
    code = F.abs(bits)
    exponent = F.shiftright(code, 52)
    fraction = code.bitwiseAND(F.lit(_FRACTION - 1)).cast("double") / F.lit(float(_FRACTION))
    normal = (1.0 + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    size = (
        F.when(exponent == 0, code.cast("double") * _SMALLEST)
        .when(code > 2047 * _FRACTION, F.lit(float("nan")))
        .when(exponent == 2047, F.lit(float("inf")))
        .otherwise(normal)
    )
    return F.when(bits < 0, -size).otherwise(size)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Rank], bounded: bool = False
) -> DataFrame:
    """Per group, the values at the given ranks: ``(*keys, n, <one per rank>)``.

    Null values do not count; rows with a null key belong to no group.  ``bounded`` states that the number of groups is
    limited by a parameter.
    """
    keys, names = list(keys), list(ranks)
    cell = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for k in keys:
        cell = cell.where(F.col(k).isNotNull())
    # Every branch below needs these columns and no others, so the shuffle that makes them is made once.
    compact = with_ordered_bits(cell, "_v", "_b").groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    digit = lambda level: F.shiftright("_b", SHIFTS[level]).bitwiseAND(F.lit(MASK if level else -1))

    whole = Window.partitionBy(*keys)
    first = compact.groupBy(*keys, digit(0).alias("_d")).agg(F.sum("_c").alias("_c"))
    counted = first.withColumns({
        "n": F.sum("_c").over(whole),
        "_upto": F.sum("_c").over(whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)),
    })
    sought = F.array(*[
        F.struct(F.lit(i).alias("_name"), ranks[k].rank.cast("bigint").alias("_rank")) for i, k in enumerate(names)
    ])
    found = _holding(counted.select(*keys, "n", "_c", "_upto", F.col("_d").alias("_high"), F.inline(sought)))
    for level in (1, 2):
        # A bin of a group and the ranks that it holds, at most one row for each group and rank.
        wanted = found.groupBy(*keys, "n", "_high").agg(F.collect_list(F.struct("_name", "_rank")).alias("_want"))
        high = F.shiftright("_b", SHIFTS[level - 1])
        inside = attach(compact.withColumn("_high", high), wanted, [*keys, "_high"], bounded or not keys)
        histogram = inside.groupBy(*keys, "n", "_high", digit(level).alias("_d"), "_want").agg(F.sum("_c").alias("_c"))
        upto = Window.partitionBy(*keys, "_high").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        placed = histogram.withColumn("_upto", F.sum("_c").over(upto)).select(
            *keys, "n", "_c", "_upto", (F.shiftleft("_high", SHIFTS[level - 1] - SHIFTS[level]) + F.col("_d")).alias("_high"), F.inline("_want"))
        found = _holding(placed)
    return found.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("_name") == i, from_bits(F.col("_high")))).alias(k) for i, k in enumerate(names)]
    )


def _holding(placed: DataFrame) -> DataFrame:
    """Of bins with their counts up to and including them, those that hold a rank; the rank goes on inside the bin."""
    before = F.col("_upto") - F.col("_c")
    inside = placed.where((F.col("_upto") > F.col("_rank")) & (before <= F.col("_rank")))
    return inside.withColumn("_rank", F.col("_rank") - before).drop("_c", "_upto")
