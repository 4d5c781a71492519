"""Summaries of a run's series and spectra."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach
from ..functions.ranks import medians, order_statistics
from ..params import MotionMeta


def window_swings(series: DataFrame) -> DataFrame:
    """Peak-to-peak velocity and displacement, and the largest phase step, per window."""
    swing = lambda c: F.array_max(c) - F.array_min(c)
    head, tail = F.slice("phase", 1, F.size("phase") - 1), F.slice("phase", 2, F.size("phase") - 1)
    steps = F.zip_with(tail, head, lambda b, a: F.abs(b - a))
    return series.select(
        "win", "quality", swing("vel_los").alias("vel_p2p"), swing("disp_los").alias("disp_p2p"),
        F.array_max(steps).alias("phase_step"),
    )


def shift_statistics(series: DataFrame, meta: MotionMeta, wavelength: float) -> DataFrame:
    """Does a run look folded?  One row per quantity, against the limit it must stay under.

    A velocity swing near wavelength/(2 dt) means the series wrapped.
    """
    limits = {
        "vel_p2p": wavelength / (2.0 * meta.dt), "disp_p2p": wavelength / 2.0,
        "phase_step": math.pi, "quality": math.inf,
    }
    swings = window_swings(series)
    pairs = F.array(*[
        F.struct(F.lit(k).alias("quantity"), F.col(k).alias("value"), F.lit(v).alias("limit"))
        for k, v in limits.items()
    ])
    long = swings.select(F.inline(pairs))
    spread = long.groupBy("quantity").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.count_if(F.col("value") > F.col("limit")).alias("n_above"),
        F.count_if(F.col("value") > 0.5 * F.col("limit")).alias("n_above_half"),
    )
    middle = order_statistics(long, ["quantity"], "value", medians(), bounded=True)
    return attach(spread, middle, ["quantity"], bounded=True).select(
        "quantity", "n_windows", "lowest", (0.5 * (F.col("mid_lo") + F.col("mid_hi"))).alias("median"),
        "highest", "n_above", "n_above_half",
    )


def strongest_windows(spectra: DataFrame, count: int = 8) -> DataFrame:
    """The most prominent windows, lowest index on ties: a top-k report."""
    return spectra.select("win", "iaz", "irg", "dominant_freq", "prominence").orderBy(
        F.col("prominence").desc(), F.col("win").asc()
    ).limit(count)


def control_report(
    spectra: DataFrame, meta: MotionMeta, frequency: float, bins: float = 2.0, keys: Sequence[str] = ()
) -> DataFrame:
    """Was a known vibration recovered, and by which window best?"""
    near = F.abs(F.col("dominant_freq") - frequency) < bins * meta.df
    entry = F.struct(
        F.col("prominence").alias("p"), (-F.col("win")).alias("w"), F.col("dominant_freq").alias("f")
    )
    found = spectra.groupBy(*keys).agg(
        F.count_if(near).alias("n_recovered"), F.max(F.when(near, entry)).alias("_b"),
        F.max("quality").alias("best_quality"),
    )
    middle = order_statistics(spectra, keys, "quality", medians()).drop("n")
    return attach(found, middle, keys).select(
        *keys, (F.col("n_recovered") > 0).alias("recovered"), "n_recovered", (-F.col("_b.w")).alias("win"),
        F.col("_b.f").alias("frequency"), F.col("_b.p").alias("prominence"), "best_quality",
        (0.5 * (F.col("mid_lo") + F.col("mid_hi"))).alias("median_quality"),
    )
