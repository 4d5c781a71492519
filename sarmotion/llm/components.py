"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie every neighbour to the smallest one: larger neighbours in a large star, the others in a small one.

    The minimum is aggregated before it is shuffled and joined back, so a hub costs one row per task and its
    edges can be split as a skewed join.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("_")).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs to (doc_id, component_id), the smallest id reachable; unlinked ids are absent.

    Rounds of the large star and the small star end when the edges no longer change, which for stars is the
    second round and for any graph a logarithmic number. Each round is a table in the shared folder. An empty
    edge table gives an empty result; repeated edges, loops and either direction are allowed; edges with a
    null end are ignored.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = written(edges.groupBy("u", "v").agg(F.lit(1).alias("_")).select("u", "v"))
    mark = _mark(current)
    while mark[0]:
        following = written(_stars(_stars(current, True), False))
        was, mark, current = mark, _mark(following), following
        if was == mark:
            break
    return current.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("doc_id"), F.col("v").alias("component_id")
    ).unionByName(current.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("v", "u")).alias("x"),
    ).first()
    return tuple(row)
