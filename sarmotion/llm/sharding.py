"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash; the number of buckets follows the measured size, so a
bucket fits a task's memory. Pass two puts each bucket in an order that does not depend on arrival and shuffles it by
Fisher-Yates with the bucket's own seed. Bucket after bucket is then one random order of all records, dealt to the
shards in turn: their row counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, bucket_count, total_text_bytes

SHARDS = 16
LEAST_SPLIT = 1000
SEED = 20_240_601
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of 0..n-1: from the last place down, swap with a place drawn from those not yet done."""
    order = np.arange(n)
    rng = np.random.default_rng(seed)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int, keys: list[str], bucket: str, place: str):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(k, "ascending") for k in keys]).combine_chunks()
        order = fisher_yates(part.num_rows, [seed, part.column(bucket)[0].as_py()])
        return part.take(pa.array(order)).append_column(place, pa.array(np.arange(part.num_rows, dtype=np.int64)))

    return lean(run)


def shuffled_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The same rows, seed and number of buckets give the same result however the table is dealt out. Null texts, null
    ids and repeated rows are records like any others; rows that are equal in id and text are interchangeable.
    Columns of ``docs`` named shard or slot are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    buckets = bucket_count(spark, total_text_bytes(docs, text_col), bucket_bytes)
    taken = {c.lower() for c in docs.columns}
    bucket, place = (next(x for x in (f"{name}{'_' * k}" for k in range(99)) if x not in taken) for name in ("bucket", "place"))
    drawn = F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.col(text_col).cast("binary")))
    apart = _repeats(docs.select(drawn.alias("drawn")), buckets)
    # Rows that are equal in id and text are interchangeable, so many of them may be dealt on by where they stand.
    many = F.lit(False) if not apart else drawn.isin(apart)
    turn = F.when(many, F.xxhash64(drawn, F.monotonically_increasing_id())).otherwise(drawn)
    scattered = docs.withColumn(bucket, F.pmod(turn, F.lit(buckets)).cast("int"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each bucket, that is for each BUCKET_BYTES of text.
    offsets = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).select(bucket, ahead.alias("ahead"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema) + f", `{place}` long"
    mixed = scattered.groupBy(bucket).applyInArrow(_shuffled(seed, [id_col, text_col], bucket, place), schema)
    at = F.col("ahead") + F.col(place)
    # Broadcast whatever its measured size, else the join deals all texts a second time.
    return mixed.join(F.broadcast(offsets), bucket).select(
        *docs.columns, (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")
    )


def _repeats(drawn: DataFrame, buckets: int) -> list[int]:
    """Hashes that more rows share than twice a bucket's part; there are fewer of them than half the buckets."""
    counts = drawn.groupBy("drawn").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SPLIT)
    common = counts.orderBy(F.desc("n")).limit(max(1, buckets // 2)).collect()
    if not common:
        return []
    least = max(LEAST_SPLIT, 2 * drawn.count() // buckets)
    return sorted(r["drawn"] for r in common if r["n"] >= least)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write shards as folders of files in slot order; a file's number is its first slot over rows_per_file."""
    cut = F.floor(F.col("slot") / rows_per_file)
    (sharded.withColumn("part", cut).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
     .write.partitionBy("shard", "part").parquet(path))
