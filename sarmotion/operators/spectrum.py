"""Vibration spectra of motion series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..errors import ArgumentError, MissingMetadata
from ..params import MotionMeta

DETRENDS = ("linear", "mean", "none")


SERIES = ("disp_az", "disp_rg", "vel_los", "disp_los", "phase")


def pack_series(
    motion: DataFrame,
    n_looks: int,
    keys: Sequence[str] = (),
    columns: Sequence[str] = SERIES,
    carry: Sequence[str] = ("iaz", "irg", "quality"),
) -> DataFrame:
    """The series form of motion: one row per window, a dense array per column.

    Absent looks hold 0.0.  A window has at most ``n_looks`` samples, so the arrays
    are bounded, and spectra and depth profiles need no further shuffle.
    """
    entry = F.struct(F.col("look").cast("int").alias("look"), *columns)
    rows = motion.groupBy(*keys, "win").agg(
        F.collect_list(entry).alias("_s"), *[F.first(c).alias(c) for c in carry]
    )
    looks = F.sequence(F.lit(0), F.lit(n_looks - 1))
    blanks = F.transform(
        F.array_except(looks, F.col("_s.look")),
        lambda i: F.struct(i.alias("look"), *[F.lit(0.0).alias(c) for c in columns]),
    )
    full = rows.withColumn("_full", F.array_sort(F.concat("_s", blanks)))
    return full.select(*keys, "win", *carry, *[F.col(f"_full.{c}").alias(c) for c in columns])


def power_spectral_density(series, n_looks: int, dt: float, detrend: str = "linear") -> Column:
    """One-sided density of an ARRAY column, Hann-weighted after detrending."""
    if detrend not in DETRENDS:
        raise ArgumentError(f"unknown detrend {detrend!r}")
    i = np.arange(n_looks, dtype=float)
    taper = 0.5 * (1.0 - np.cos(2.0 * math.pi * i / (n_looks - 1)))
    power = float((taper**2).sum()) or 1.0
    scale = np.full(n_looks // 2 + 1, 2.0)
    scale[0] = 1.0
    if n_looks % 2 == 0:
        scale[-1] = 1.0
    scale *= dt / power
    basis = np.stack([np.ones(n_looks), i - i.mean()])[: {"linear": 2, "mean": 1, "none": 0}[detrend]]
    basis = basis / np.linalg.norm(basis, axis=1, keepdims=True)

    @pandas_udf("array<double>")
    def density(values: pd.Series) -> pd.Series:
        y = np.stack(values.to_numpy()) if len(values) else np.zeros((0, n_looks))
        y = y - (y @ basis.T) @ basis
        psd = np.abs(np.fft.rfft(y * taper, axis=1)) ** 2 * scale
        return pd.Series(list(psd))

    return density(series)


def lowest_bin(meta: MotionMeta, f_min: float = 0.0) -> int:
    """First bin eligible as a peak: never DC, never below ``f_min``."""
    n_freq = meta.n_looks // 2 + 1
    if f_min <= 0:
        return 1
    return min(max(1, math.ceil(f_min / meta.df)), n_freq - 1)


def unpack_series(series: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = SERIES) -> DataFrame:
    """The long form again: one row per window and look."""
    zipped = series.select(
        *keys, "win", "iaz", "irg", "quality",
        F.posexplode(F.arrays_zip(*columns)).alias("look", "_v"),
    )
    return zipped.select(*keys, "win", "iaz", "irg", "look", *[f"_v.{c}" for c in columns], "quality")


def spectrum(
    series: DataFrame,
    meta: MotionMeta,
    source: str = "velocity",
    f_min: float = 0.0,
    detrend: str = "linear",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per window: ``psd`` array, dominant frequency, amplitude, prominence, excursion."""
    if meta.n_looks < 4:
        raise ArgumentError(f"{meta.n_looks} looks are too few to estimate a spectrum")
    if not meta.dt > 0:
        raise MissingMetadata("the look interval is unset")
    column = {"velocity": "vel_los", "displacement": "disp_los"}.get(source)
    if column is None:
        raise ArgumentError(f"unknown spectrum source {source!r}")
    psd = power_spectral_density(column, meta.n_looks, meta.dt, detrend)
    rows = series.select(
        *keys, "win", "iaz", "irg", "quality", psd.alias("psd"),
        (F.array_max("disp_az") - F.array_min("disp_az")).alias("excursion_px"),
    )
    return peaks(rows, meta, f_min)


def peaks(rows: DataFrame, meta: MotionMeta, f_min: float = 0.0) -> DataFrame:
    """Add the dominant bin and its strength to rows holding a ``psd`` array."""
    k_min = lowest_bin(meta, f_min)
    n_freq = meta.n_looks // 2 + 1
    band = F.slice("psd", k_min + 1, n_freq - k_min)
    top = F.array_max("_band")
    mean = F.aggregate("_band", F.lit(0.0), lambda a, x: a + x) / (n_freq - k_min)
    bin_ = (F.array_position("_band", F.col("_top")) - 1 + k_min).cast("int")
    return (
        rows.withColumn("_band", band)
        .withColumns({"_top": top, "_mean": mean})
        .withColumn("dominant_bin", bin_)
        .withColumns({
            "dominant_freq": F.col("dominant_bin") * F.lit(meta.df),
            "amplitude": F.sqrt("_top"),
            "prominence": F.when(F.col("_mean") > 0, F.col("_top") / F.col("_mean")).otherwise(0.0),
        })
        .drop("_band", "_top", "_mean")
    )


def spectrum_bins(spectra: DataFrame, meta: MotionMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Long form: ``(*keys, win, k, freq, psd)``."""
    return spectra.select(*keys, "win", F.posexplode("psd").alias("k", "psd")).select(
        *keys, "win", "k", (F.col("k") * F.lit(meta.df)).alias("freq"), "psd"
    )
