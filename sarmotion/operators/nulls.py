"""What the same chain reports when there is nothing to find."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..params import MotionMeta, TrackParams
from .selection import best_window
from .spectrum import pack_series, spectrum
from .subaperture import ImageStack
from .tracking import track, track_trials


def _xorshift32(state: int) -> int:
    # Fixed shift triple of the published 32-bit generator.
    state ^= (state << 13) & 0xFFFFFFFF
    state ^= state >> 17
    return state ^ ((state << 5) & 0xFFFFFFFF)


def permutation(n_looks: int, seed: int, order: list[int] | None = None) -> list[int]:
    """Fisher-Yates shuffle of look numbers; element i is the look placed at i."""
    order = list(range(n_looks)) if order is None else list(order)
    state = (seed & 0xFFFFFFFF) or 1
    for i in range(n_looks - 1, 0, -1):
        state = _xorshift32(state)
        j = state % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def permutations(n_looks: int, trials: int) -> list[tuple[int, int, int]]:
    """(trial, look, placed_at) rows; each trial reshuffles the one before it."""
    rows, order = [], None
    for trial in range(trials):
        order = permutation(n_looks, (trial * 2654435761 + 1) & 0xFFFFFFFF, order)
        rows += [(trial, look, at) for at, look in enumerate(order)]
    return rows


def shuffled(
    stack: ImageStack, trials: int | list[tuple[int, int, int]], keys: Sequence[str] = ()
) -> ImageStack:
    """The stack with its looks permuted in time, once per ``trial``.

    Master and slave of a pair move together.
    """
    rows = permutations(stack.meta.n_looks, trials) if isinstance(trials, int) else trials
    spark = stack.pixels.sparkSession
    # trials x looks rows.
    table = F.broadcast(spark.createDataFrame(rows, "trial bigint, look bigint, _at bigint"))

    def moved(pixels: DataFrame | None) -> DataFrame | None:
        if pixels is None:
            return None
        return pixels.join(table, "look").select(
            *keys, "trial", F.col("_at").alias("look"), "az", "rg", "re", "im"
        )

    return replace(stack, pixels=moved(stack.pixels), slave=moved(stack.slave), paired=None)


def shuffle_once(stack: ImageStack, seed: int) -> ImageStack:
    """The stack with its time order destroyed by one seeded shuffle."""
    order = permutation(stack.meta.n_looks, seed)
    once = shuffled(stack, [(0, look, at) for at, look in enumerate(order)])
    drop = lambda d: None if d is None else d.drop("trial")
    return replace(once, pixels=drop(once.pixels), slave=drop(once.slave))


def trial_motion(
    stack: ImageStack, params: TrackParams, trials: int, keys: Sequence[str] = ()
) -> tuple[DataFrame, MotionMeta]:
    """Motion of every shuffle of the looks, ``trial`` among the keys.

    Correlation compares pairs of looks, and a pair is the same whatever the order round it: its pixels are shuffled and
    registered once for all trials.  The other estimators see a whole stack, so they run on permuted stacks.
    """
    if params.estimator == "correlation" and params.reference != "pair":
        return track_trials(stack, params, permutations(stack.meta.n_looks, trials), keys)
    return track(shuffled(stack, trials, keys), params, [*keys, "trial"])


def prominences(
    stack: ImageStack, params: TrackParams, trials: int, f_min: float = 0.0,
    source: str = "velocity", detrend: str = "linear", keys: Sequence[str] = (),
) -> DataFrame:
    """Best prominence per trial through the identical chain; 0 where nothing resolves."""
    motion, meta = trial_motion(stack, params, trials, keys)
    keys = [*keys, "trial"]
    series = pack_series(motion, meta.n_looks, keys)
    spectra = spectrum(series, meta, source, f_min, detrend, keys)
    best = best_window(spectra, meta, keys)
    return best.select(
        *keys, F.coalesce("prominence", F.lit(0.0)).alias("prominence"), "dominant_freq"
    )


def null_summary(trials: DataFrame, real: float) -> DataFrame:
    """Where a measured prominence falls in its null distribution."""
    reached = F.count_if(F.col("prominence") >= real)
    return trials.agg(
        F.lit(float(real)).alias("real"),
        F.avg("prominence").alias("mean"),
        F.stddev_pop("prominence").alias("sd"),
        F.max("prominence").alias("worst"),
        F.count(F.lit(1)).alias("n_trials"),
        reached.alias("n_ge"),
        ((reached + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )


def shuffle_null(
    stack: ImageStack, params: TrackParams, trials: int, real: float,
    f_min: float = 0.0, source: str = "velocity", detrend: str = "linear",
) -> DataFrame:
    """Null from destroying the looks' order; all trials run as one job."""
    if trials <= 0:
        raise ArgumentError("a null needs a positive trial count")
    return null_summary(prominences(stack, params, trials, f_min, source, detrend), real)
