"""Division of an aperture into a time-ordered stack of looks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, MissingMetadata, RangeFault
from ..functions.geometry import bin_frequency
from ..functions.transforms import fft, fft_shift
from ..params import Grid, ImageMeta, StackMeta, SubapParams
from ..session import cut_lineage
from .focus import Collect, PulseWindows, backproject, full_aperture, image_meta


@dataclass(frozen=True)
class ImageStack:
    """Pixels ``(look, az, rg, re, im)``; ``slave`` holds the paired bands, if any.

    ``paired`` holds both, told apart by a boolean ``slave``, where they come from one pass.
    """

    pixels: DataFrame
    meta: StackMeta
    slave: DataFrame | None = None
    paired: DataFrame | None = None


def paired_stack(paired: DataFrame, meta: StackMeta) -> ImageStack:
    side = lambda slave: paired.where(F.col("slave") == slave).drop("slave")
    return ImageStack(side(False), meta, side(True), paired)


def pulse_windows(n_pulse: int, n_looks: int, overlap: float) -> PulseWindows:
    """Equal overlapping pulse windows that together span the collect."""
    if n_looks <= 0:
        raise ArgumentError("n_looks must be positive")
    if not 0.0 <= overlap < 1.0:
        raise ArgumentError(f"overlap {overlap} is outside [0, 1)")
    per = int(n_pulse / (1.0 + (n_looks - 1) * (1.0 - overlap)))
    step = int(per * (1.0 - overlap)) if n_looks > 1 else 0
    if per == 0 or (n_looks > 1 and step == 0):
        raise ArgumentError(
            f"{n_pulse} pulses cannot be divided into {n_looks} looks at {overlap} overlap"
        )
    return PulseWindows(n_looks, per, step, n_pulse)


def looks_of_pulse(windows: PulseWindows, pulse: str = "pulse"):
    """ARRAY of the looks a pulse belongs to.

    Looks are found by arithmetic on the pulse number, so assigning them is a
    projection and not a range join.
    """
    p = F.col(pulse) - windows.first
    last_start = windows.n_pulse - windows.per
    step = max(windows.step, 1)
    # Windows pinned to the end of the collect all start at last_start.
    pinned = F.lit(windows.n_looks)
    if windows.step > 0:
        pinned = F.lit(min(windows.n_looks, last_start // step + 1))
    lo = F.greatest(F.lit(0), F.ceil((p - windows.per + 1) / step))
    hi = F.least(pinned - 1, F.floor(p / step))
    free = F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint")))
    tail = F.when(
        (pinned < windows.n_looks) & (p >= last_start),
        F.sequence(pinned.cast("bigint"), F.lit(windows.n_looks - 1).cast("bigint")),
    )
    none = F.array().cast("array<bigint>")
    return F.concat(F.coalesce(free, none), F.coalesce(tail, none))


def from_pulses(collect: Collect, grid: Grid, params: SubapParams) -> ImageStack:
    """Focus each pulse window separately."""
    if params.mode == "paper":
        raise ArgumentError(
            "the paper layout is defined on the Doppler spectrum; focus first and split"
        )
    meta = collect.meta
    windows = pulse_windows(meta.n_pulse, params.n_looks, params.overlap)
    prf = meta.prf if meta.prf > 0 else 1.0
    image, centres = image_meta(collect, grid, windows)
    t_sap = windows.per / prf
    dt = windows.step / prf if params.n_looks > 1 else 0.0
    stack = StackMeta(
        n_looks=params.n_looks,
        image=image,
        dt=dt,
        f_max=1.0 / (2.0 * dt) if dt > 0 else 0.0,
        t_sap=t_sap,
        az_resolution=_azimuth_resolution(image, t_sap),
        centre_times=tuple(centres),
    )
    return ImageStack(backproject(collect, grid, windows, params.range_taps), stack)


def _azimuth_resolution(image: ImageMeta, t: float) -> float:
    denom = 2.0 * image.v_platform * t
    return image.wavelength * image.r0 / denom if denom > 0 else 0.0


def pack_columns(image: DataFrame) -> DataFrame:
    """One row per range column: ``(rg, re ARRAY, im ARRAY)`` in azimuth order."""
    packed = image.groupBy("rg").agg(
        F.array_sort(F.collect_list(F.struct("az", "re", "im"))).alias("_c")
    )
    return packed.select("rg", F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))


def centred_power(columns: DataFrame, *keys: str) -> DataFrame:
    """Squared magnitude of each column's centred transform: ``(*keys, power ARRAY)``."""
    spectra = columns.select(*keys, fft("re", "im").alias("_f"))
    power = F.zip_with("_f.re", "_f.im", lambda a, b: a * a + b * b)
    return spectra.select(*keys, fft_shift(power).alias("power"))


def azimuth_power_spectrum(columns: DataFrame, *keys: str) -> DataFrame:
    """Mean over range columns of the azimuth power spectrum: ``(*keys, k, power)``."""
    spectra = centred_power(columns, *keys).select(*keys, F.posexplode("power").alias("k", "p"))
    return spectra.groupBy(*keys, "k").agg(F.avg("p").alias("power"))


def doppler_centroid(power: DataFrame, n_az: int, fs_az: float, *keys: str) -> DataFrame:
    """Power-weighted mean frequency; NULL where there is no energy."""
    f = bin_frequency("k", n_az, fs_az)
    moments = power.groupBy(*keys).agg(
        F.sum(f * F.col("power")).alias("_num"), F.sum("power").alias("_den")
    )
    return moments.select(
        *keys, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).alias("centroid_hz")
    )


def doppler_bandwidth(
    power: DataFrame, n_az: int, fs_az: float, *keys: str, fraction: float = 0.5
) -> DataFrame:
    """Width of the run of bins above ``fraction`` of the peak, edges included."""
    if not 0.0 < fraction < 1.0:
        raise ArgumentError(f"power fraction {fraction} is outside (0, 1)")
    whole = Window.partitionBy(*keys)
    by_power = whole.orderBy(F.col("power").desc(), F.col("k").asc())
    marked = power.withColumn("_peak_k", F.first("k").over(by_power)).withColumn(
        "_level", F.max("power").over(whole) * fraction
    )
    quiet = F.col("power") <= F.col("_level")
    k, peak = F.col("k"), F.col("_peak_k")
    edges = marked.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(quiet & (k < peak), k)), F.lit(0)).alias("_lo"),
        F.coalesce(F.min(F.when(quiet & (k > peak), k)), F.lit(n_az - 1)).alias("_hi"),
    )
    return edges.select(
        *keys, ((F.col("_hi") - F.col("_lo")) * fs_az / n_az).alias("bandwidth_hz")
    )


@dataclass(frozen=True)
class BandLayout:
    centres: tuple[float, ...]
    width: float
    step: float
    t_sap: float
    dt: float
    b_shift: float = 0.0


def band_layout(params: SubapParams, bandwidth: float, dwell: float) -> BandLayout:
    """Where each look's Doppler band lies, relative to the centroid."""
    n, span = params.n_looks, (dwell if dwell > 0 else 1.0)
    if params.mode == "paper":
        if not 0.0 < params.left_out_frac < 1.0:
            raise ArgumentError(f"left_out_frac {params.left_out_frac} is outside (0, 1)")
        width = bandwidth * (1.0 - params.left_out_frac)
        # The printed formula (B_CD - B_DL) / N; the prose's B_DL / N agrees with it
        # only when half the band is left out.
        step = width / n
        shift = params.b_shift_hz if params.b_shift_hz > 0 else step
        first = -0.5 * bandwidth + 0.5 * width
        if params.pair:
            top = first + (n - 1) * step + shift + 0.5 * width
            if top > 0.5 * bandwidth + 1e-9 * max(1.0, bandwidth):
                raise ArgumentError(
                    f"a separation of {shift:g} Hz does not fit {n} rigid pairs inside "
                    f"the {bandwidth:g} Hz Doppler band"
                )
        dt = span * step / bandwidth if n > 1 else 0.0
    else:
        if params.pair:
            raise ArgumentError("pair mode needs the paper band layout")
        if not 0.0 <= params.overlap < 1.0:
            raise ArgumentError(f"overlap {params.overlap} is outside [0, 1)")
        width = bandwidth / (n - (n - 1) * params.overlap)
        step = width * (1.0 - params.overlap)
        first = -0.5 * bandwidth + 0.5 * width
        shift = 0.0
        dt = span * step / bandwidth
    centres = tuple(first + i * step for i in range(n))
    return BandLayout(centres, width, step, span * width / bandwidth, dt, shift)


def _band_gain(f: np.ndarray, centre: float, width: float, window: bool) -> np.ndarray:
    d = np.abs(f - centre)
    if not window:
        return (d <= 0.5 * width).astype(float)
    roll = 0.25 * width
    flat = 0.5 * width - roll
    edge = 0.5 * (1.0 + np.cos(np.pi * (d - flat) / roll))
    return np.where(d <= flat, 1.0, np.where(d >= 0.5 * width, 0.0, edge))


# Samples of all looks that one step of the split holds.
_SPLIT_SAMPLES = 1 << 20


def _filter_columns(columns: DataFrame, gains: np.ndarray) -> DataFrame:
    """Apply every look's band to every column: ``(look, az, rg, re, im)``."""
    n_looks, n_az = gains.shape
    schema = pa.schema(
        [("look", pa.int64()), ("az", pa.int32()), ("rg", pa.int32()),
         ("re", pa.float64()), ("im", pa.float64())]
    )

    def lines(batch: pa.RecordBatch, k: int) -> np.ndarray:
        return np.asarray(batch.column(k).flatten(), np.float64).reshape(-1, n_az)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, _SPLIT_SAMPLES // (n_looks * n_az))
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                n = batch.num_rows
                spectrum = np.fft.fftshift(np.fft.fft(lines(batch, 1) + 1j * lines(batch, 2), axis=1), axes=1)
                bands = np.fft.ifftshift(spectrum[:, None, :] * gains[None, :, :], axes=2)
                looks = np.fft.ifft(bands, axis=2).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.repeat(np.arange(n_looks, dtype=np.int64), n_az), n)),
                        pa.array(np.tile(np.arange(n_az, dtype=np.int32), n * n_looks)),
                        pa.array(np.repeat(np.asarray(batch.column(0)).astype(np.int32), n_looks * n_az)),
                        pa.array(looks.real),
                        pa.array(looks.imag),
                    ],
                    schema=schema,
                )

    return columns.select("rg", "re", "im").mapInArrow(
        split, "look bigint, az int, rg int, re double, im double"
    )


def split(image: DataFrame, meta: ImageMeta, params: SubapParams) -> ImageStack:
    """Divide a focused image's Doppler band into looks."""
    if params.n_looks <= 0:
        raise ArgumentError("n_looks must be positive")
    if meta.n_az < 2 * params.n_looks:
        raise ArgumentError(
            f"{meta.n_az} azimuth lines are too few for {params.n_looks} looks"
        )
    if meta.fs_az <= 0:
        raise MissingMetadata("the image has no azimuth sampling rate")
    if not math.isfinite(params.b_shift_hz) or params.b_shift_hz < 0:
        raise ArgumentError("b_shift_hz must be finite and non-negative")
    if params.pair and params.mode != "paper":
        raise ArgumentError("pair mode needs the paper band layout")
    # Read for the power and again for the looks; kept in reliable storage, not in a cache that nobody frees.
    columns = cut_lineage(pack_columns(image))
    power = azimuth_power_spectrum(columns)
    spread = doppler_centroid(power, meta.n_az, meta.fs_az).crossJoin(
        doppler_bandwidth(power, meta.n_az, meta.fs_az)
    ).first()
    centroid = spread["centroid_hz"]
    if centroid is None:
        raise RangeFault("the image has no energy")
    bandwidth = spread["bandwidth_hz"]
    if bandwidth <= 0:
        bandwidth = 0.8 * meta.fs_az
    layout = band_layout(params, bandwidth, meta.t_dwell)
    k = np.arange(meta.n_az)
    f = (k - meta.n_az // 2) * meta.fs_az / meta.n_az - centroid

    def gains(shift: float) -> np.ndarray:
        bands = [_band_gain(f, c + shift, layout.width, params.window) for c in layout.centres]
        return np.stack(bands)

    stack = StackMeta(
        n_looks=params.n_looks,
        image=replace(meta, t_dwell=layout.t_sap, source="sublook"),
        dt=layout.dt,
        f_max=1.0 / (2.0 * layout.dt) if layout.dt > 0 else 0.0,
        t_sap=layout.t_sap,
        az_resolution=_azimuth_resolution(meta, layout.t_sap),
        doppler_centroid=centroid,
        doppler_bandwidth=bandwidth,
        b_shift_hz=layout.b_shift,
        pair_lag_s=layout.b_shift * meta.t_dwell / bandwidth if meta.t_dwell > 0 else 0.0,
        has_slave=params.pair,
        centre_times=tuple(meta.t0 + i * layout.dt for i in range(params.n_looks)),
    )
    if not params.pair:
        return ImageStack(_filter_columns(columns, gains(0.0)), stack)
    # Each column is transformed once for the bands of both roles.
    bands = _filter_columns(columns, np.concatenate([gains(0.0), gains(layout.b_shift)]))
    slave = F.col("look") >= params.n_looks
    paired = bands.select((F.col("look") % params.n_looks).alias("look"), "az", "rg", "re", "im", slave.alias("slave"))
    return paired_stack(paired, stack)


def build(collect: Collect, grid: Grid, params: SubapParams, route: str = "pulse") -> ImageStack:
    """Form looks by ``pulse`` windows, or by a ``uniform`` or ``paper`` spectral split."""
    if route == "pulse":
        return from_pulses(collect, grid, replace(params, mode="uniform"))
    if route not in ("uniform", "paper"):
        raise ArgumentError(f"route {route!r} is not pulse, uniform or paper")
    windows = full_aperture(collect.meta)
    image = backproject(collect, grid, windows, params.range_taps)
    meta, _ = image_meta(collect, grid, windows)
    return split(image, meta, replace(params, mode=route))
