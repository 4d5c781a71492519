"""Which window, and which frequency, the spectra support."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RangeFault
from ..functions.geometry import spectrum_observation_ratio, subaperture_response
from ..functions.joins import attach
from ..params import QUANT_FLOOR_SIGMA, MotionMeta
from ..session import cut_lineage


def excursion_floor(meta: MotionMeta) -> float:
    return QUANT_FLOOR_SIGMA * meta.quant_px if meta.quant_px > 0 else 0.0


def gate(spectra: DataFrame, meta: MotionMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Windows within half the best quality whose excursion clears quantisation."""
    keys = list(keys)
    # One row per scene: the maximum is a partial aggregate, not a gathered column.
    best = spectra.groupBy(*keys).agg(F.greatest(F.max("quality"), F.lit(0.0)).alias("_qmax"))
    joined = attach(spectra, best, keys)
    passed = F.col("quality") >= 0.5 * F.col("_qmax")
    floor = excursion_floor(meta)
    if floor > 0:
        passed = passed & (F.col("excursion_px") >= floor)
    return joined.withColumn("passed", passed).drop("_qmax")


def best_window(spectra: DataFrame, meta: MotionMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Most prominent eligible window per scene, lowest index on ties.

    ``win`` is NULL, and ``n_candidates`` 0, where no window is eligible.
    """
    gated = gate(spectra, meta, keys)
    fields = ["win", "dominant_freq", "prominence", "quality", "excursion_px"]
    entry = F.struct(
        F.col("prominence").alias("p"), (-F.col("win")).alias("w"), *[F.col(c) for c in fields]
    )
    top = gated.groupBy(*keys).agg(
        F.max(F.when(F.col("passed"), entry)).alias("_b"),
        F.count_if("passed").alias("n_candidates"),
    )
    return top.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in fields], "n_candidates")


def require_window(best: DataFrame, meta: MotionMeta) -> dict:
    """The single selected window, or a refusal."""
    row = best.first()
    if row is None or row["win"] is None:
        raise RangeFault(
            f"no window resolved motion above the {excursion_floor(meta):g} px floor"
        )
    return row.asDict()


def consensus(spectra: DataFrame, meta: MotionMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Frequency most eligible windows agree on, to half a bin.

    Voters are first collapsed to one row per distinct frequency, of which a
    spectrum has at most as many as it has bins; agreement is then a range window
    over those rows, so no pair of voters is ever formed.
    """
    keys = list(keys)
    tolerance = 0.5 * meta.df if meta.df > 0 else 1e-9
    votes = gate(spectra, meta, keys).where("passed")
    tally = votes.groupBy(*keys, "dominant_freq").agg(
        F.count(F.lit(1)).alias("_n"), F.min("win").alias("_first")
    )
    near = (
        Window.partitionBy(*keys)
        .orderBy(F.col("dominant_freq") / tolerance)
        .rangeBetween(-1, 1)
    )
    agreed = tally.withColumns({
        "_agree": F.sum("_n").over(near),
        "_earliest": F.min("_first").over(near),
    })
    winner = F.max(F.struct(F.col("_agree").alias("n"), (-F.col("dominant_freq")).alias("f")))
    return agreed.groupBy(*keys).agg(
        winner.alias("_w"),
        F.count_if(F.col("_first") == F.col("_earliest")).alias("n_distinct"),
        F.sum("_n").alias("n_voting"),
    ).select(
        *keys,
        (-F.col("_w.f")).alias("consensus_freq"),
        F.col("_w.n").alias("n_agree"),
        "n_distinct",
        "n_voting",
    )


def agreeing(spectra: DataFrame, meta: MotionMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Every window with its gate verdict and whether it backs the consensus."""
    keys = list(keys)
    gated = gate(spectra, meta, keys)
    winner = consensus(spectra, meta, keys).select(*keys, "consensus_freq")
    joined = attach(gated, winner, keys, how="left")
    close = F.abs(F.col("dominant_freq") - F.col("consensus_freq")) <= 0.5 * meta.df
    return joined.withColumn("agrees", F.col("passed") & F.coalesce(close, F.lit(False)))


def connected_blocks(cells: DataFrame, keys: Sequence[str] = (), tile: int = 64) -> DataFrame:
    """Label 4-connected cells: ``(*keys, iaz, irg, block)``.

    Cells are labelled within square tiles of bounded size; only labels touching
    across a tile edge then take part in a distributed minimum-label propagation
    with path shortening, checkpointed every round.
    """
    keys = list(keys)
    spark = cells.sparkSession

    def label_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {(a, r): (a, r) for a, r in zip(pdf["iaz"], pdf["irg"])}

        def find(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for a, r in list(parent):
            for other in ((a + 1, r), (a, r + 1)):
                if other in parent:
                    low, high = sorted((find((a, r)), find(other)))
                    parent[high] = low
        roots = [find(c) for c in zip(pdf["iaz"], pdf["irg"])]
        out = pdf.copy()
        out["la"], out["lr"] = [c[0] for c in roots], [c[1] for c in roots]
        return out

    keyed = cells.select(
        *keys, F.col("iaz").cast("bigint"), F.col("irg").cast("bigint"),
        F.floor(F.col("iaz") / tile).alias("_ta"), F.floor(F.col("irg") / tile).alias("_tr"),
    )
    added = [T.StructField(c, T.LongType()) for c in ("la", "lr")]
    schema = T.StructType([*keyed.schema.fields, *added])
    local = cut_lineage(
        keyed.groupBy(*keys, "_ta", "_tr").applyInPandas(label_tile, schema)
    ).withColumn("_label", F.struct("la", "lr"))

    # Pairs of tile-local labels that touch across an edge: a shifted equi-join.
    edge_a = (F.col("iaz") + 1) % tile == 0
    edge_r = (F.col("irg") + 1) % tile == 0
    after = local.select(*keys, "iaz", "irg", F.col("_label").alias("_to"))
    steps = [
        local.where(edge).select(
            *keys, (F.col("iaz") + da).alias("iaz"), (F.col("irg") + dr).alias("irg"),
            F.col("_label").alias("_from"),
        )
        for edge, da, dr in ((edge_a, 1, 0), (edge_r, 0, 1))
    ]
    touching = steps[0].unionByName(steps[1]).join(after, [*keys, "iaz", "irg"]).select(
        *keys, "_from", "_to"
    )
    both = touching.unionByName(
        touching.select(*keys, F.col("_to").alias("_from"), F.col("_from").alias("_to"))
    ).distinct()
    edges = cut_lineage(both)
    if edges.isEmpty():
        return local.select(*keys, "iaz", "irg", F.col("_label").alias("block"))

    labels = cut_lineage(
        edges.select(*keys, F.col("_from").alias("_node")).distinct().withColumn("_low", F.col("_node"))
    )
    while True:
        offered = edges.join(
            labels.select(*keys, F.col("_node").alias("_to"), F.col("_low").alias("_offer")), [*keys, "_to"]
        ).groupBy(*keys, F.col("_from").alias("_node")).agg(F.min("_offer").alias("_offer"))
        hooked = labels.join(offered, [*keys, "_node"]).select(
            *keys, "_node", F.col("_low").alias("_was"), F.least("_low", "_offer").alias("_low")
        )
        # Path shortening: adopt the label of one's label.  Many nodes may share a
        # label, so the labels in use are looked up once and joined back salted.
        own = hooked.select(*keys, F.col("_node").alias("_low"), F.col("_low").alias("_lower"))
        jump = hooked.select(*keys, "_low").distinct().join(own, [*keys, "_low"])
        moved = cut_lineage(
            attach(hooked, jump, [*keys, "_low"], how="left").select(
                *keys, "_node", "_was", F.coalesce(F.least("_low", "_lower"), "_low").alias("_low")
            )
        )
        labels = moved.select(*keys, "_node", "_low")
        if moved.where(F.col("_was") != F.col("_low")).isEmpty():
            break
    final = labels.withColumnRenamed("_node", "_label")
    return local.join(final, [*keys, "_label"], "left").select(
        *keys, "iaz", "irg", F.coalesce("_low", "_label").alias("block")
    )


def largest_block(cells: DataFrame, keys: Sequence[str] = (), tile: int = 64) -> DataFrame:
    """Size of the largest 4-connected block per scene."""
    sizes = connected_blocks(cells, keys, tile).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return sizes.groupBy(*keys).agg(F.max("_n").alias("n_contiguous"))


def consensus_refused(n_agree, n_voting) -> Column:
    """True where fewer than a third agree, as a motionless scene would have it."""
    agree, voting = F.col(n_agree), F.col(n_voting)
    return (voting > 0) & (agree < voting / 3.0)


def warnings(meta: MotionMeta) -> Column:
    """ARRAY of cautions about a selected window and its consensus."""
    f = F.col("dominant_freq")
    eta = spectrum_observation_ratio(meta.t_sap, f)
    response = subaperture_response(meta.t_sap, f)
    near = F.abs(eta - F.floor(eta + 0.5))
    cautions = [
        ("above_band", (f >= 1.0 / (2.0 * meta.t_sap)) if meta.t_sap > 0 else F.lit(False)),
        ("scattered", (F.col("n_contiguous") > 0) & (F.col("n_contiguous") < 4)),
        ("few_candidates", F.lit(meta.quant_px > 0) & F.col("n_candidates").between(1, 3)),
        ("flat_spectrum", F.col("prominence") < 3.0),
        ("attenuated", response < 0.1),
        ("near_null", (eta > 0.5) & (near < 0.15)),
        ("near_nyquist", f > 0.9 * meta.f_max),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in cautions]))
