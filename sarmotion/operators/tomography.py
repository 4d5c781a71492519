"""Depth profiles from motion series or spectra.

Every model is a small fixed matrix applied to each window: a steering matrix, its
regularised inverse, or a map from frequency bins to depth cells.  The matrices
depend on parameters only (looks x depths), are built once on the driver and ride
along with the task; windows are streamed through them and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..errors import ArgumentError, RangeFault, SarMotionError, SingularFault
from ..params import CONVENTIONS, MotionMeta, TomoParams

MODELS = ("A", "B", "C", "D")
# Items of the steering matrices that a task decomposes at a time.
STACK = 1 << 20


def time_scale(t):
    """Factor of a literal time in the depth phase; 1 where there is none."""
    t = np.asarray(t, float)
    return np.where(t > 0, 2.0 * math.pi * t, 1.0)


def eq22_scale(params: TomoParams) -> float:
    return float(time_scale(params.eq22_literal_t))


def acoustic_wavelength(params: TomoParams) -> float:
    if params.velocity <= 0 or params.frequency <= 0:
        return 0.0
    return params.velocity / (CONVENTIONS[params.convention] * params.frequency)


def _carrier(params: TomoParams) -> float:
    if params.model == "C":
        return params.radar_wavelength if params.radar_wavelength > 0 else 0.031
    return acoustic_wavelength(params)


def wavenumber(params: TomoParams, baseline, wavelength: float):
    denom = wavelength * params.slant_range * math.sin(params.incidence)
    return 4.0 * math.pi * np.asarray(baseline, float) / denom if denom else np.zeros_like(baseline)


def depth_resolution(params: TomoParams) -> float:
    scale = eq22_scale(params) if params.model == "A" else 1.0
    if params.aperture <= 0:
        return 0.0
    return _carrier(params) * params.slant_range / (2.0 * params.aperture) / scale


def repeat_depth(top, n_looks: int):
    """Depth beyond which a profile of ``n_looks`` looks up to the wavenumber ``top`` repeats; 0 where undefined."""
    top = np.asarray(top, float)
    known = (top > 0) & (n_looks > 0)
    return np.where(known, 2.0 * math.pi * n_looks / np.where(known, top, 1.0), 0.0)


def max_depth(params: TomoParams, n_looks: int) -> float:
    """Depth beyond which a profile repeats; 0 where undefined."""
    return float(repeat_depth(wavenumber(params, params.aperture, _carrier(params)) * eq22_scale(params), n_looks))


def check_params(params: TomoParams) -> None:
    """Refuse parameters under which a depth axis would be meaningless."""
    p = params
    if p.model not in MODELS:
        raise ArgumentError(f"unknown model {p.model!r}")
    if not p.velocity > 0:
        raise ArgumentError("a wave speed must be assumed; it has no default")
    if p.model != "D" and not p.frequency > 0:
        raise ArgumentError("an investigation frequency must be assumed; it has no default")
    if not 100.0 <= p.velocity <= 20000.0:
        raise RangeFault(f"assumed wave speed {p.velocity:g} m/s is outside [100, 20000]")
    if not (p.depth_max > 0 and p.depth_cell > 0):
        raise ArgumentError("depth extent and cell must be positive")
    if p.depth_cell > p.depth_max:
        raise ArgumentError("the depth cell exceeds the depth extent")
    if not (p.slant_range > 0 and p.aperture > 0):
        raise ArgumentError("slant range and aperture must be positive")
    if not 0.0 < p.incidence < math.pi / 2:
        raise RangeFault(f"incidence {p.incidence:g} rad is outside (0, pi/2)")
    if not math.isfinite(p.eq22_literal_t) or p.eq22_literal_t < 0:
        raise ArgumentError("the literal steering time must be finite and not negative")
    if p.eq22_literal_t > 0 and (p.model != "A" or p.solver != "lstsq"):
        raise ArgumentError("the literal steering time needs model A with least squares")
    lam, scale = _carrier(p), eq22_scale(p)
    finest = lam * p.slant_range / (2.0 * p.aperture) / scale
    if finest > 0 and p.depth_cell < finest:
        raise RangeFault(
            f"depth cell {p.depth_cell:g} m is finer than the {finest:g} m this geometry resolves"
        )


def check_extent(params: TomoParams, n_looks: int) -> None:
    """Refuse a profile that would fold back on itself."""
    if params.model in ("A", "C"):
        limit = max_depth(params, n_looks)
        if limit > 0 and params.depth_max > limit:
            raise RangeFault(
                f"depth extent {params.depth_max:g} m exceeds the {limit:g} m represented "
                f"without ambiguity by {n_looks} looks"
            )


def depth_axis(params: TomoParams) -> np.ndarray:
    count = int(params.depth_max / params.depth_cell) + 1
    return np.arange(count) * params.depth_cell


def steering_matrix(params: TomoParams, n_looks: int, depth: np.ndarray | None = None) -> np.ndarray:
    """exp(j Kz z) with baselines spread evenly along the aperture."""
    depth = depth_axis(params) if depth is None else depth
    baseline = params.aperture * np.arange(n_looks) / n_looks
    kz = wavenumber(params, baseline, acoustic_wavelength(params)) * eq22_scale(params)
    return np.exp(1j * np.outer(kz, depth))


def conditioning(params: TomoParams, n_looks: int, n_depth: int, rank_tol: float = 1e-3) -> dict:
    """Extreme singular values, condition number and effective rank of the steering."""
    if n_looks <= 0 or n_depth <= 0:
        raise ArgumentError("conditioning needs a look count and a depth count")
    rank_tol = rank_tol if rank_tol > 0 else 1e-3
    matrix = steering_matrix(params, n_looks, np.arange(n_depth) * params.depth_cell)
    return {k: v[0].item() for k, v in _conditioned(matrix[None], rank_tol).items()}


def _conditioned(matrices: np.ndarray, rank_tol: float) -> dict[str, np.ndarray]:
    """Of every steering matrix of a batch: extreme singular values, their ratio, and how many are not negligible."""
    values = np.linalg.svd(matrices, compute_uv=False)
    high, low = values.max(axis=1), values.min(axis=1)
    with np.errstate(divide="ignore"):
        condition = np.where(low > 0, high / np.where(low > 0, low, 1.0), math.inf)
    return {"sv_max": high, "sv_min": low, "condition": condition, "rank": (values > rank_tol * high[:, None]).sum(axis=1)}


def conditioning_rows(
    requests: DataFrame, top: str, cell: str, n_looks: int, n_depth: int, rank_tol: float = 1e-3
) -> DataFrame:
    """Conditioning of each row's steering: adds ``sv_max, sv_min, rank``.

    ``top`` is the wavenumber of the whole aperture and ``cell`` the depth step, both columns.  Matrices are decomposed in
    stacks of bounded size, inside the tasks that hold the rows.
    """
    if n_looks <= 0 or n_depth <= 0:
        raise ArgumentError("conditioning needs a look count and a depth count")
    step = max(1, STACK // (n_looks * n_depth))

    @pandas_udf("sv_max double, sv_min double, rank bigint")
    def decomposed(tops: pd.Series, cells: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(tops), step):
            phase = tops.to_numpy(float)[at : at + step, None, None] * (np.arange(n_looks) / n_looks)[None, :, None]
            depth = cells.to_numpy(float)[at : at + step, None, None] * np.arange(n_depth)[None, None, :]
            parts.append(pd.DataFrame(_conditioned(np.exp(1j * phase * depth), rank_tol)))
        found = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"sv_max": [], "sv_min": [], "rank": []})
        return found[["sv_max", "sv_min", "rank"]].astype({"rank": "int64"})

    return requests.withColumn("_c", decomposed(F.col(top).cast("double"), F.col(cell).cast("double"))).select(
        *requests.columns, "_c.*")


def _inverse_operator(params: TomoParams, n_looks: int) -> np.ndarray:
    """Tikhonov-regularised inverse of the steering matrix, depths x looks."""
    a = steering_matrix(params, n_looks)
    ah = a.conj().T
    tall = a.shape[0] >= a.shape[1]
    gram = ah @ a if tall else a @ ah
    n = len(gram)
    gram = gram + params.regularisation * (np.trace(gram).real / n) * np.eye(n)
    try:
        inverse = np.linalg.inv(gram)
    except np.linalg.LinAlgError:
        inverse = None
    if inverse is None or not np.isfinite(inverse).all():
        raise SingularFault(
            "the steering system is singular; raise the regularisation or change the grid"
        )
    return inverse @ ah if tall else ah @ inverse


def _linear_weights(position: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation at fractional indices; zero outside [0, n - 1)."""
    inside = (position >= 0) & (position < n - 1)
    base = np.where(inside, position, 0.0).astype(int)
    frac = position - base
    rows = np.arange(len(position))
    weights = np.zeros((len(position), n))
    weights[rows, base] = np.where(inside, 1.0 - frac, 0.0)
    if n > 1:
        weights[rows, base + 1] += np.where(inside, frac, 0.0)
    return weights


def standing_wave_weights(params: TomoParams, freq: np.ndarray, resolution: float) -> np.ndarray:
    """Bins x depths: Gaussians at every multiple of half each bin's wavelength."""
    depth = depth_axis(params)
    sigma = max(resolution if resolution > 0 else params.depth_cell, params.depth_cell)
    weights = np.zeros((len(freq), len(depth)))
    for k, f in enumerate(freq):
        if k == 0 or f <= 0:
            continue
        half = params.velocity / (CONVENTIONS[params.convention] * f) / 2.0
        orders = np.arange(1, int(params.depth_max / half + 1e-9) + 2) * half
        orders = orders[orders <= params.depth_max]
        dz = (depth[None, :] - orders[:, None]) / sigma
        weights[k] = np.where(np.abs(dz) <= 3.0, np.exp(-0.5 * dz * dz), 0.0).sum(axis=0)
    return weights


def resonance_weights(params: TomoParams, freq: np.ndarray, refuse: bool = True) -> np.ndarray:
    """Bins x depths: each bin lands on z = v/2f; bins sharing a cell are averaged.

    Depths that lie outside the spectrum entirely are refused, or without ``refuse`` have no weight.
    """
    depth = depth_axis(params)
    weights = np.zeros((len(freq), len(depth)))
    hi, lo = freq[-1], freq[1] if len(freq) > 1 else 0.0
    if refuse and hi > 0 and lo > 0:
        shallow, deep = params.velocity / (2.0 * hi), params.velocity / (2.0 * lo)
        if depth[-1] < shallow or depth[0] > deep:
            raise RangeFault(
                f"this spectrum represents {shallow:g} to {deep:g} m; the requested depths "
                "lie outside it entirely"
            )
    for k, f in enumerate(freq):
        if k == 0 or f <= 0:
            continue
        z = params.velocity / (2.0 * f)
        if depth[0] <= z <= depth[-1]:
            cell = int((z - depth[0]) / params.depth_cell + 0.5)
            if cell < len(depth):
                weights[k, cell] = 1.0
    hits = weights.sum(axis=0)
    return weights / np.where(hits > 0, hits, 1.0)


@dataclass(frozen=True)
class Focuser:
    """``apply`` maps (windows x samples) to (windows x depths)."""

    params: TomoParams
    inputs: str  # motion | spectrum
    depth: np.ndarray
    apply: Callable[[np.ndarray], np.ndarray]

    @property
    def wavelength(self) -> float:
        return acoustic_wavelength(self.params)


def focuser(
    params: TomoParams, meta: MotionMeta, baselines: Sequence[float] | None = None, refuse_outside: bool = True
) -> Focuser:
    """Build one model's operator, after every refusal that applies to it.

    Without ``refuse_outside`` a spectrum that represents none of model D's depths gives an empty profile.
    """
    check_params(params)
    check_extent(params, meta.n_looks)
    n, depth = meta.n_looks, depth_axis(params)
    freq = np.arange(n // 2 + 1) * meta.df if meta.dt > 0 else np.zeros(0)
    if params.model in ("B", "D"):
        if len(freq) < 2:
            raise ArgumentError(f"model {params.model} needs vibration spectra")
        if params.model == "B":
            weights = standing_wave_weights(params, freq, depth_resolution(params))
            return Focuser(params, "spectrum", depth, lambda psd: np.sqrt(np.maximum(psd, 0.0)) @ weights)
        weights = resonance_weights(params, freq, refuse_outside)
        return Focuser(params, "spectrum", depth, lambda psd: psd @ weights)
    if params.model == "C":
        if baselines is None or len(baselines) != n:
            raise ArgumentError(f"model C needs {n} perpendicular baselines")
        kz = wavenumber(params, np.asarray(baselines, float), _carrier(params))
        matrix = np.exp(-1j * np.outer(kz, depth)) / n
        return Focuser(params, "motion", depth, lambda y: np.abs(y @ matrix))
    if params.solver == "lstsq":
        inverse = _inverse_operator(params, n).T
        return Focuser(params, "motion", depth, lambda y: np.abs(y @ inverse))
    if params.solver != "dft":
        raise ArgumentError(f"unknown solver {params.solver!r}")
    taper = np.ones(n)
    if params.window:
        taper = 0.5 * (1.0 - np.cos(2.0 * math.pi * np.arange(n) / (n - 1)))
    limit = max_depth(params, n)
    step = limit / n
    resample = _linear_weights(depth / step if step > 0 else np.full(len(depth), -1.0), n).T
    return Focuser(
        params, "motion", depth,
        lambda y: np.abs(np.fft.fft(y * taper, axis=1)) @ resample,
    )


def data_columns(params: TomoParams) -> list[str]:
    """Series columns a model's complex data vector is made of."""
    columns = {"shifts": ["disp_az", "disp_rg"], "los": ["disp_los"]}.get(params.y_source)
    if columns is None:
        raise ArgumentError(f"unknown data vector {params.y_source!r}")
    return columns


def data_vectors(params: TomoParams, meta: MotionMeta, columns: Sequence[np.ndarray]) -> np.ndarray:
    """Windows x looks complex data: scaled shifts, or line-of-sight displacement."""
    if params.y_source == "los":
        y = columns[0].astype(np.complex128)
    else:
        az = meta.az_spacing if meta.az_spacing > 0 else 1.0
        rg = meta.rg_spacing if meta.rg_spacing > 0 else 1.0
        y = columns[0] * az + 1j * (columns[1] * rg)
    return y - y.mean(axis=1, keepdims=True) if params.remove_y_mean else y


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def profiles(
    params: TomoParams,
    meta: MotionMeta,
    series: DataFrame | None = None,
    spectra: DataFrame | None = None,
    baselines: Sequence[float] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per window: ``(*keys, win, iaz, irg, quality, profile ARRAY)``."""
    model = focuser(params, meta, baselines)
    carry = [*keys, "win", "iaz", "irg", "quality"]
    if model.inputs == "spectrum":
        if spectra is None:
            raise ArgumentError(f"model {params.model} needs vibration spectra")

        @pandas_udf("array<double>")
        def focus_psd(psd: pd.Series) -> pd.Series:
            return pd.Series(list(model.apply(_matrix(psd))))

        return spectra.select(*carry, focus_psd("psd").alias("profile"))
    if series is None:
        raise ArgumentError(f"model {params.model} needs motion series")

    @pandas_udf("array<double>")
    def focus_series(*columns: pd.Series) -> pd.Series:
        y = data_vectors(params, meta, [_matrix(c) for c in columns])
        return pd.Series(list(model.apply(y)))

    return series.select(*carry, focus_series(*data_columns(params)).alias("profile"))


def profile_cells(profile: DataFrame, params: TomoParams, keys: Sequence[str] = ()) -> DataFrame:
    """Long form: ``(*keys, win, iaz, irg, j, depth, value)``."""
    return profile.select(
        *keys, "win", "iaz", "irg", F.posexplode("profile").alias("j", "value")
    ).select(
        *keys, "win", "iaz", "irg", "j",
        (F.col("j") * F.lit(float(params.depth_cell))).alias("depth"), "value",
    )


def window_peaks(profile: DataFrame, params: TomoParams) -> DataFrame:
    """Add each window's strongest depth, the surface cell excluded, first on ties."""
    body = F.slice("profile", 2, F.greatest(F.size("profile") - 1, F.lit(0)))
    top = F.array_max("_body")
    out = profile.withColumn("_body", body).withColumn("peak_value", top)
    j = F.array_position("_body", F.col("peak_value")).cast("int")
    return out.withColumn("peak_bin", j).withColumn(
        "peak_depth", F.col("peak_bin") * F.lit(float(params.depth_cell))
    ).drop("_body")


def mean_profile(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over windows per depth cell: ``(*keys, j, value, total)``."""
    long = profile.select(*keys, F.posexplode("profile").alias("j", "v"))
    return long.groupBy(*keys, "j").agg(F.avg("v").alias("value"), F.sum("v").alias("total"))


def interpolated_peak(mean: DataFrame, cell: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """Depth and height of each mean profile's peak, refined by a parabola."""
    cell = cell if isinstance(cell, Column) else F.lit(float(cell))
    along = Window.partitionBy(*keys).orderBy("j")
    seen = mean.select(
        *keys, "j", "value",
        F.lag("value").over(along).alias("_y0"), F.lead("value").over(along).alias("_y2"),
    ).where(F.col("j") >= 1)
    best = seen.groupBy(*keys).agg(
        F.max(F.struct("value", (-F.col("j")).alias("n"), "_y0", "_y2")).alias("_b")
    )
    y1, y0, y2 = F.col("_b.value"), F.col("_b._y0"), F.col("_b._y2")
    curve = y0 - 2.0 * y1 + y2
    offset = F.when(
        y2.isNotNull() & (curve != 0),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (y0 - y2) / curve)),
    ).otherwise(0.0)
    return best.select(
        *keys, (((-F.col("_b.n")) + offset) * cell).alias("peak_depth"), y1.alias("peak_value")
    )


def stack_contrast(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Peak over median of the profile summed across windows; 0 without a median."""
    return _contrast(mean_profile(profile, keys).select(*keys, "j", "total"), keys)


def _contrast(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One row per depth cell here, so the exact percentile sees a bounded column.
    stats = totals.groupBy(*keys).agg(
        F.greatest(F.max("total"), F.lit(0.0)).alias("_peak"),
        F.percentile("total", 0.5).alias("_median"),
    )
    return stats.select(
        *keys, F.when(F.col("_median") > 0, F.col("_peak") / F.col("_median")).otherwise(0.0).alias("contrast")
    )


def circular_shift(trial: int, win: int, n_depth: int, seed: int) -> int:
    """Shift of one window in one trial, drawn from a digest of its identity."""
    return int(hashlib.md5(f"{seed}:{trial}:{win}".encode()).hexdigest()[:8], 16) % n_depth


def realigned_totals(profile: DataFrame, n_depth: int, trials: int, seed: int = 1) -> DataFrame:
    """``(trial, j, total)`` parts of the stacks of shifted profiles: trials x depths rows for each task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((trials, n_depth))
        # Depth cell j of the stack takes cell j - s of profiles shifted by s.
        back = (np.arange(n_depth)[None, :] - np.arange(n_depth)[:, None]) % n_depth
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            wins = batch.column(0).to_pylist()
            lines = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(wins), n_depth)
            for trial in range(trials):
                shifts = [circular_shift(trial, w, n_depth, seed) for w in wins]
                by_shift = np.zeros((n_depth, n_depth))
                np.add.at(by_shift, shifts, lines)
                totals[trial] += np.take_along_axis(by_shift, back, axis=1).sum(axis=0)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(trials), n_depth)), pa.array(np.tile(np.arange(n_depth), trials)),
                    pa.array(totals.ravel()),
                ],
                names=["trial", "j", "total"],
            )

    return profile.select("win", "profile").mapInArrow(fold, "trial bigint, j bigint, total double")


def realigned_contrasts(profile: DataFrame, n_depth: int, trials: int, seed: int = 1) -> DataFrame:
    """Contrast per trial after shifting every window's profile at random."""
    if trials <= 0 or n_depth <= 0:
        raise ArgumentError("an alignment null needs trials and a depth axis")
    parts = realigned_totals(profile, n_depth, trials, seed)
    return _contrast(parts.groupBy("trial", "j").agg(F.sum("total").alias("total")), ["trial"])


def alignment_null(profile: DataFrame, n_depth: int, trials: int, seed: int = 1) -> DataFrame:
    """The stacked contrast against its distribution under random re-alignment."""
    real = stack_contrast(profile).withColumnRenamed("contrast", "real")
    null = realigned_contrasts(profile, n_depth, trials, seed)
    return null.crossJoin(F.broadcast(real)).agg(
        F.first("real").alias("real"),
        F.avg("contrast").alias("mean"),
        F.stddev_pop("contrast").alias("sd"),
        F.max("contrast").alias("worst"),
        F.count_if(F.col("contrast") >= F.col("real")).alias("n_ge"),
        ((F.count_if(F.col("contrast") >= F.col("real")) + 1) / (trials + 1)).alias("p_value"),
    )


def sweep_assumptions(
    params: TomoParams, meta: MotionMeta, scale_min: float, scale_max: float, n_scale: int,
    refuse_outside: bool = True,
) -> list[Focuser]:
    """Every feasible (velocity, frequency) pair of a logarithmic scale grid."""
    if n_scale < 2 or not 0 < scale_min < scale_max:
        raise ArgumentError("a sweep needs two or more scales and 0 < min < max")
    scales = np.exp(np.linspace(math.log(scale_min), math.log(scale_max), n_scale))
    feasible = []
    for fv in scales:
        for ff in scales:
            trial = replace(
                params, velocity=float(params.velocity * fv), frequency=float(params.frequency * ff)
            )
            try:
                feasible.append(focuser(trial, meta, refuse_outside=refuse_outside))
            except SarMotionError:
                continue
    if not feasible:
        raise RangeFault("no parameter combination gives a usable depth grid")
    return feasible


def sweep(
    params: TomoParams,
    meta: MotionMeta,
    series: DataFrame | None = None,
    spectra: DataFrame | None = None,
    scale_min: float = 0.5,
    scale_max: float = 2.0,
    n_scale: int = 5,
    keys: Sequence[str] = (),
    refuse_outside: bool = True,
) -> DataFrame:
    """Where the peak lands under each assumed (velocity, frequency).

    The windows are read once: each task sums every assumption's profiles over the
    windows it holds, and only assumptions x depths partial sums are shuffled.
    An assumption whose depths lie outside the spectrum entirely has no row; without
    ``refuse_outside`` its row has the peak value 0.
    """
    models = sweep_assumptions(params, meta, scale_min, scale_max, n_scale, refuse_outside)
    keys = list(keys)
    if models[0].inputs == "spectrum":
        if spectra is None:
            raise ArgumentError(f"model {params.model} needs vibration spectra")
        source = spectra.select(*[F.col(k).cast("bigint").alias(k) for k in keys], "psd")
    else:
        if series is None:
            raise ArgumentError(f"model {params.model} needs motion series")
        source = series.select(
            *[F.col(k).cast("bigint").alias(k) for k in keys], *data_columns(params)
        )
    n_depth, n_keys = len(models[0].depth), len(keys)
    schema = pa.schema(
        [(k, pa.int64()) for k in keys]
        + [("assumption", pa.int32()), ("j", pa.int32()), ("s", pa.float64()), ("n", pa.int64())]
    )

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            read = lambda i: np.asarray(batch.column(i).flatten()).reshape(batch.num_rows, -1)
            columns = [read(i) for i in range(n_keys, batch.num_columns)]
            from_motion = models[0].inputs == "motion"
            data = data_vectors(params, meta, columns) if from_motion else columns[0]
            group = [np.asarray(batch.column(i)) for i in range(n_keys)]
            stacked = np.stack(group, axis=1) if keys else np.zeros((len(data), 0), np.int64)
            for value in np.unique(stacked, axis=0):
                rows = data[(stacked == value).all(axis=1)]
                total = np.stack([m.apply(rows).sum(axis=0) for m in models])
                columns = [np.full(total.size, v, np.int64) for v in value]
                columns += [
                    np.repeat(np.arange(len(models), dtype=np.int32), n_depth),
                    np.tile(np.arange(n_depth, dtype=np.int32), len(models)),
                    total.ravel(),
                    np.full(total.size, len(rows), np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    fields = ", ".join([f"{k} bigint" for k in keys] + ["assumption int, j int, s double, n bigint"])
    sums = source.mapInArrow(partial_sums, fields).groupBy(*keys, "assumption", "j").agg(
        (F.sum("s") / F.sum("n")).alias("value")
    )
    peaks = interpolated_peak(sums, params.depth_cell, [*keys, "assumption"])
    table = source.sparkSession.createDataFrame(
        [
            (i, m.params.velocity, m.params.frequency, m.wavelength, depth_resolution(m.params))
            for i, m in enumerate(models)
        ],
        "assumption int, velocity double, frequency double, lambda_ac double, resolution double",
    )
    # At most n_scale^2 rows.
    return peaks.join(F.broadcast(table), "assumption").select(
        *keys, "velocity", "frequency", "lambda_ac", "resolution", "peak_depth", "peak_value"
    )


# Wavelengths that differ by no more than this share of the later one are the same.
SAME_WAVELENGTH = 1e-9


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("peak_depth") > 0) & (F.col("lambda_ac") > 0))


def _first_seen(rows: DataFrame, order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order if c in rows.columns], "lambda_ac")


def _chains(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Chains of wavelengths none of which is more than the tolerance from the next: ``(*keys, _all)``.

    ``_all`` holds each distinct wavelength once, by first appearance, with the moments of its rows.  Only wavelengths of one
    chain can meet.  Rows are folded before the shuffle, so what is sorted is the distinct wavelengths, of which a
    sweep has one for each assumption.
    """
    distinct = (
        _usable(rows)
        .groupBy(*keys, "lambda_ac")
        .agg(
            F.min(F.struct(_first_seen(rows, order).alias("seen"), "peak_depth")).alias("_first"),
            F.count(F.lit(1)).alias("n"), F.avg("peak_depth").alias("depth"), F.var_pop("peak_depth").alias("var"),
            F.avg("peak_value").alias("value"),
        )
    )
    along = Window.partitionBy(*keys).orderBy("lambda_ac")
    step = F.col("lambda_ac") - F.lag("lambda_ac").over(along)
    apart = F.coalesce((step > SAME_WAVELENGTH * F.col("lambda_ac")).cast("int"), F.lit(1))
    numbered = distinct.withColumn("_apart", apart).withColumn("_chain", F.sum("_apart").over(along))
    own = F.struct(F.col("_first.seen").alias("seen"), "lambda_ac", F.col("_first.peak_depth").alias("first_depth"), "n", "depth", "var", "value")
    return numbered.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(own)).alias("_all")).drop("_chain")


def _meet(anchor: Column, row: Column) -> Column:
    return F.abs(anchor["lambda_ac"] - row["lambda_ac"]) <= SAME_WAVELENGTH * row["lambda_ac"]


def sweep_merge(rows: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("velocity", "frequency")) -> DataFrame:
    """Mean and population spread of the depth per acoustic wavelength.

    A group is named by the first of its rows that no earlier group takes in, and has all rows within the tolerance of
    it; the groups of two such rows may share rows between them.
    """
    # The element type of the chain carries over to the anchors, which start as none of it.
    chained = _chains(rows, keys, order)
    anchors = F.aggregate(
        "_all", F.filter("_all", lambda x: F.lit(False)),
        lambda held, x: F.when(F.exists(held, lambda a: _meet(a, x)), held).otherwise(F.concat(held, F.array(x))),
    )
    total = lambda f: F.aggregate("_own", F.lit(0.0), lambda acc, x: acc + f(x))
    grouped = chained.withColumn("_anchor", F.explode(anchors)).withColumn(
        "_own", F.filter("_all", lambda x: F.abs(x["lambda_ac"] - F.col("_anchor.lambda_ac")) <= SAME_WAVELENGTH * F.col("_anchor.lambda_ac")))
    counted = grouped.withColumn("n_rows", F.aggregate("_own", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]))
    mean = counted.withColumn("peak_depth", total(lambda x: x["n"] * x["depth"]) / F.col("n_rows"))
    spread = total(lambda x: x["n"] * (x["var"] + F.pow(x["depth"] - F.col("peak_depth"), 2))) / F.col("n_rows")
    return mean.select(
        *keys, F.col("_anchor.lambda_ac").alias("lambda_ac"), "peak_depth",
        (total(lambda x: x["n"] * x["value"]) / F.col("n_rows")).alias("peak_value"), F.sqrt(spread).alias("sd"), "n_rows",
    )


def _log_fit(rows: DataFrame, keys: Sequence[str], x: str = "lambda_ac") -> DataFrame:
    lx, ly = F.ln(x), F.ln("peak_depth")
    fit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_used"),
        F.regr_slope(ly, lx).alias("_slope"),
        F.corr(lx, ly).alias("_corr"),
    )
    enough = F.col("n_used") >= 3
    finite = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return fit.select(
        *keys, "n_used",
        F.when(enough, finite(F.col("_slope"))).alias("slope"),
        F.when(enough, finite(F.col("_corr"))).alias("correlation"),
    )


def sweep_summary(rows: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("velocity", "frequency")) -> DataFrame:
    """Log-log slope of depth on wavelength, one row per distinct wavelength: rows within the tolerance of any earlier
    row are left out.

    ``slope`` is NULL with fewer than three distinct wavelengths.
    """
    earlier = lambda all_, x: F.exists(all_, lambda e: (e["seen"] < x["seen"]) & _meet(e, x))
    kept = _chains(rows, keys, order).select(
        *keys, F.inline(F.filter("_all", lambda x: ~earlier(F.col("_all"), x)))
    )
    return _log_fit(kept.select(*keys, "lambda_ac", F.col("first_depth").alias("peak_depth")), keys)


def sweep_summary_reliable(merged: DataFrame, max_rel_sd: float = 0.10, keys: Sequence[str] = ()) -> DataFrame:
    """The same fit over wavelengths whose depth reproduces across realisations."""
    if not max_rel_sd >= 0:
        raise ArgumentError("the relative spread must not be negative")
    steady = F.col("sd") <= max_rel_sd * F.col("peak_depth")
    return _log_fit(_usable(merged).where(steady), keys)


def velocity_fit(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Depth against assumed velocity, the variable a resonance map depends on."""
    return _log_fit(rows.where((F.col("peak_depth") > 0) & (F.col("velocity") > 0)), keys, "velocity")


def nearest_slice(profile: DataFrame, params: TomoParams, depth_m: float) -> DataFrame:
    """The plane nearest a depth, shallower on ties: ``(win, iaz, irg, j, depth, value)``."""
    axis = depth_axis(params)
    j = int(np.argmin(np.abs(axis - depth_m)))
    return profile.select(
        "win", "iaz", "irg", F.lit(j).alias("j"), F.lit(float(axis[j])).alias("depth"),
        F.element_at("profile", j + 1).alias("value"),
    )


def section(
    profile: DataFrame, params: TomoParams, meta: MotionMeta,
    start: tuple[float, float], stop: tuple[float, float], samples: int,
) -> DataFrame:
    """Profiles of the windows nearest a line: ``(sample, j, depth, value)``."""
    if samples < 2:
        raise ArgumentError("a section needs at least two samples")
    share = F.col("id") / F.lit(float(samples - 1))

    def nearest(a: float, b: float, count: int) -> Column:
        at = F.lit(float(a)) + share * F.lit(float(b - a))
        away = F.signum(at) * F.floor(F.abs(at) + 0.5)
        return F.least(F.greatest(away, F.lit(0)), F.lit(count - 1)).cast("bigint")

    line = profile.sparkSession.range(samples).select(
        F.col("id").alias("sample"),
        (nearest(start[0], stop[0], meta.n_win_az) * meta.n_win_rg
         + nearest(start[1], stop[1], meta.n_win_rg)).alias("win"),
    )
    # The line has ``samples`` rows, a drawing width.
    picked = profile.select("win", "profile").join(F.broadcast(line), "win")
    return picked.select("sample", F.posexplode("profile").alias("j", "value")).select(
        "sample", "j", (F.col("j") * F.lit(float(params.depth_cell))).alias("depth"), "value"
    )


def metadata(params: TomoParams, meta: MotionMeta, exhaustive: bool = False) -> dict:
    """Everything a reader of a depth cube needs in order to distrust it."""
    n_depth = len(depth_axis(params))
    exact = (
        params.model == "A" and params.patent_exact and params.y_source == "shifts"
        and params.convention == "patent" and params.solver == "lstsq"
        and not params.remove_y_mean and not params.window and not params.subap_window
        and params.pair_reference and params.coherence_min == 0 and params.regularisation == 0
    )
    chain = None
    if params.model == "A":
        chain = "conditioned"
        if exact:
            chain = "experimental literal steering" if params.eq22_literal_t > 0 else "patent chain"
    return {
        "model": params.model,
        "arithmetic_mode": "exhaustive" if exhaustive else "local refinement",
        "measurement_chain": params.provenance or "UNRECORDED",
        "solver": params.solver,
        "assumed_velocity_ms": params.velocity,
        "assumed_frequency_hz": params.frequency,
        "y_vector_source": params.y_source,
        "wavelength_convention": params.convention,
        "acoustic_wavelength_m": acoustic_wavelength(params),
        "slant_range_m": params.slant_range,
        "incidence_deg": math.degrees(params.incidence),
        "depth_resolution_m": depth_resolution(params),
        "depth_unambiguous_m": max_depth(params, meta.n_looks),
        **{f"steering_{k}": v for k, v in conditioning(params, meta.n_looks, n_depth).items()},
        "n_sub_apertures": meta.n_looks,
        "depth_cell_m": params.depth_cell,
        "depth_max_m": params.depth_max,
        "n_windows": meta.n_win,
        "n_depth_cells": n_depth,
        "y_mean_removed": params.remove_y_mean,
        "depth_taper": "hann" if params.window else "none",
        "subaperture_taper": "raised-cosine" if params.subap_window else "none",
        "coherence_min": params.coherence_min,
        "tracking_reference": "pair" if params.pair_reference else "not pair",
        "regularisation": params.regularisation,
        "eq22_literal_t": params.eq22_literal_t,
        "eq22_kz_scale": eq22_scale(params),
        "chain_verdict": chain,
    }
