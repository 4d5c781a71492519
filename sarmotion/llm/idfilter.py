"""A filter of fixed size for ids, to thin a wide table before an exact semi-join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.llm.common import lean, mix64

FILTER_BITS = 1 << 26
PROBES = 4


def _places(ids: np.ndarray, probe: int, bits: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (probe + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix64(ids.astype(np.int64).view(np.uint64) ^ seed) % np.uint64(bits)


def _marks(bits: int):
    def run(batches):
        for batch in batches:
            ids = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.unique(np.concatenate([_places(ids, p, bits) for p in range(PROBES)]))
            words = at >> np.uint64(6)
            starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(at) else np.zeros(0, np.int64)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(at) else at
            yield pa.record_batch(
                [pa.array(words[starts].astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"]
            )

    return lean(run)


def sieve(ids: DataFrame, id_col: str = "doc_id", bits: int = FILTER_BITS):
    """The filter of ``ids`` as a broadcast of ``bits`` bits, whatever their number."""
    found = (
        ids.select(F.col(id_col)).mapInArrow(_marks(bits), "word long, mask long")
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(table)


def _sieved(held, id_col: str, bits: int, inside: bool):
    def run(batches):
        bitmap = held.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(id_col))
            own = column.fill_null(0).to_numpy(zero_copy_only=False)
            found = column.is_valid().to_numpy(zero_copy_only=False).copy()
            for probe in range(PROBES):
                at = _places(own, probe, bits)
                found &= (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
            keep = found if inside else ~found
            if keep.any():
                yield batch.filter(pa.array(keep))

    return lean(run)


def thinned(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose id is probably in ``ids``; none that is goes missing.

    The more ids, the more other rows pass, and a semi-join must follow. Null ids do not pass.
    """
    return rows.mapInArrow(_sieved(sieve(ids, id_col, bits), id_col, bits, True), rows.schema)


def without(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose id is not in ``ids``; rows without an id stay.

    Rows that the fixed-size filter clears stay where they are; only the others are joined.
    """
    apart = sieve(ids, id_col, bits)
    gone = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return rows.mapInArrow(_sieved(apart, id_col, bits, False), rows.schema).unionByName(
        rows.mapInArrow(_sieved(apart, id_col, bits, True), rows.schema).join(gone, id_col, "left_anti").select(rows.columns)
    )
