"""Image formation: backprojection of pulses onto a ground grid.

Each task turns the pulses it already holds into partial images and only those are
shuffled, so the phase history never moves.  A partial image is summed per cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, MissingMetadata
from ..params import CollectMeta, Grid, ImageMeta

# Largest (pulse x cell) block one task holds at a time.
_BLOCK = 1 << 20
_EMITTED = 1 << 16
# Look images that one task keeps at a time.
ACCUMULATOR_BYTES = 128 << 20
_SINC_STEPS = 2048


@dataclass(frozen=True)
class Collect:
    """Pulses (one row each), the scalars they share, and the pulses' geometry if it can be read without samples."""

    pulses: DataFrame
    meta: CollectMeta
    track: DataFrame | None = None

    @property
    def geometry(self) -> DataFrame:
        """``(pulse, t, px, py, pz, r_ref)``."""
        source = self.pulses if self.track is None else self.track
        return source.select("pulse", "t", "px", "py", "pz", "r_ref")


@dataclass(frozen=True)
class PulseWindows:
    """Which pulses each look is formed from: ``[start(i), start(i) + per)``."""

    n_looks: int
    per: int
    step: int
    n_pulse: int
    first: int = 0

    def start(self, look: int) -> int:
        return self.first + min(look * self.step, self.n_pulse - self.per)

    @property
    def starts(self) -> np.ndarray:
        looks = np.arange(self.n_looks, dtype=np.int64) * self.step
        return self.first + np.minimum(looks, self.n_pulse - self.per)

    def members(self, pulse: np.ndarray) -> np.ndarray:
        """Looks x pulses: whether a look is formed from a pulse."""
        starts = self.starts[:, None]
        return (pulse[None, :] >= starts) & (pulse[None, :] < starts + self.per)


def full_aperture(meta: CollectMeta, start: int = 0, count: int | None = None) -> PulseWindows:
    count = meta.n_pulse - start if count is None else count
    if count <= 0 or start < 0 or start + count > meta.n_pulse:
        raise ArgumentError(
            f"pulse window [{start}, {start + count}) is outside {meta.n_pulse} pulses"
        )
    return PulseWindows(1, count, 0, count, start)


def _sinc_table(taps: int) -> np.ndarray:
    half = taps // 2
    frac = np.arange(_SINC_STEPS + 1)[:, None] / _SINC_STEPS
    x = frac - np.arange(-half + 1, half + 1)[None, :]
    return np.sinc(x) * 0.5 * (1.0 + np.cos(np.pi * x / half))


def _sample(signal: np.ndarray, fbin: np.ndarray, taps: int, table) -> np.ndarray:
    """Interpolate each pulse's range line at fractional bins; zero off the swath."""
    n_rbin = signal.shape[1]
    inside = (fbin >= 0.0) & (fbin < n_rbin - 1)
    base = np.where(inside, fbin, 0.0).astype(np.int64)
    frac = np.where(inside, fbin - base, 0.0)
    rows = np.arange(signal.shape[0])[:, None]
    value = signal[rows, base] * (1.0 - frac) + signal[rows, base + 1] * frac
    if taps:
        half = taps // 2
        centred = inside & (base >= half) & (base + half < n_rbin)
        p, c = np.nonzero(centred)
        weights = table[(frac[p, c] * _SINC_STEPS + 0.5).astype(np.int64)]
        reach = base[p, c][:, None] + np.arange(-half + 1, half + 1)[None, :]
        value[p, c] = np.einsum("ij,ij->i", signal[p[:, None], reach], weights)
    return np.where(inside, value, 0.0)


def _lists(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def backproject(
    collect: Collect,
    grid: Grid,
    windows: PulseWindows | None = None,
    range_taps: int = 0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Focus one image per look: ``(*keys, look, az, rg, re, im)``.

    ``keys`` are integer columns of the pulses (a trial number, say) that separate
    independent phase histories sharing one geometry.
    """
    parts = partial_images(collect, grid, windows, range_taps, keys)
    return parts.groupBy(*keys, "look", "az", "rg").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im")
    )


def partial_images(
    collect: Collect,
    grid: Grid,
    windows: PulseWindows | None = None,
    range_taps: int = 0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Each partition's contribution to each look it holds pulses of, merged over the partition's batches.

    A task keeps one image for each look in use, up to ``ACCUMULATOR_BYTES`` and two looks at least; beyond
    that, looks that the current batch leaves alone are handed on early.  With pulses in order, as collects are
    written, that is each look once.
    """
    meta = collect.meta
    if meta.wavelength <= 0 or meta.dr <= 0:
        raise MissingMetadata("phase history lacks wavelength or range spacing")
    windows = windows or full_aperture(meta)
    taps = 0 if range_taps < 4 else min(range_taps, 16)
    table = _sinc_table(taps) if taps else None
    keys = list(keys)
    starts, per = windows.starts, windows.per
    n_rbin, dr, relative = meta.n_rbin, meta.dr, meta.phase_ref_srp
    k_phase = 4.0 * math.pi / meta.wavelength
    n_cell = grid.n_x * grid.n_y
    gz = grid.origin[2] + grid.height

    names = [*keys, "look", "az", "rg", "re", "im"]
    types = [pa.int64()] * (len(keys) + 1) + [pa.int32()] * 2 + [pa.float64()] * 2
    out_schema = pa.schema(list(zip(names, types)))

    def emit(group: tuple, look: int, image: np.ndarray) -> Iterator[pa.RecordBatch]:
        for c0 in range(0, n_cell, _EMITTED):
            cell = np.arange(c0, min(n_cell, c0 + _EMITTED))
            columns = [np.full(len(cell), g, np.int64) for g in (*group, look)]
            columns += [(cell // grid.n_y).astype(np.int32), (cell % grid.n_y).astype(np.int32)]
            columns += [image.real[cell], image.imag[cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out_schema)

    def project(rows, position, r_ref, signal, weight, images) -> None:
        """Add the pulses ``rows`` to the images of their looks, a block of cells at a time."""
        chunk = max(1, _BLOCK // max(1, min(len(rows), 1024)))
        for c0 in range(0, n_cell, chunk):
            cell = np.arange(c0, min(n_cell, c0 + chunk))
            gx = grid.origin[0] + (cell // grid.n_y - 0.5 * (grid.n_x - 1)) * grid.dx
            gy = grid.origin[1] + (cell % grid.n_y - 0.5 * (grid.n_y - 1)) * grid.dy
            for p0 in range(0, len(rows), 1024):
                r = rows[p0 : p0 + 1024]
                dx = position[r, 0:1] - gx
                dy = position[r, 1:2] - gy
                dz = position[r, 2:3] - gz
                dist = np.sqrt(dx * dx + dy * dy + dz * dz)
                lag = dist - r_ref[r, None]
                value = _sample(signal[r], lag / dr + 0.5 * n_rbin, taps, table)
                value = value * np.exp(1j * k_phase * (lag if relative else dist))
                for image, part in zip(images, weight[:, p0 : p0 + 1024] @ value):
                    image[c0 : c0 + len(cell)] += part

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        room = max(2, ACCUMULATOR_BYTES // (16 * n_cell))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = lambda n: np.asarray(batch.column(batch.schema.get_field_index(n)))
            pulse, r_ref = column("pulse"), column("r_ref")
            position = np.stack([column(n) for n in ("px", "py", "pz")], axis=1)
            signal = _lists(batch, "re", n_rbin) + 1j * _lists(batch, "im", n_rbin)
            member = windows.members(pulse)
            groups = np.stack([column(k) for k in keys], axis=1) if keys else np.zeros((len(pulse), 0), np.int64)
            for group in np.unique(groups, axis=0):
                rows = np.nonzero((groups == group).all(axis=1))[0]
                touched = np.nonzero(member[:, rows].any(axis=1))[0]
                for l0 in range(0, len(touched), room):
                    looks = touched[l0 : l0 + room]
                    wanted = [(*(int(g) for g in group), int(look)) for look in looks]
                    for old in [k for k in held if k not in wanted][: max(0, len(held) + len(wanted) - room)]:
                        yield from emit(old[:-1], old[-1], held.pop(old))
                    images = [held.setdefault(k, np.zeros(n_cell, np.complex128)) for k in wanted]
                    weight = member[np.ix_(looks, rows)].astype(np.float64)
                    project(rows, position, r_ref, signal, weight, images)
        for key, image in held.items():
            yield from emit(key[:-1], key[-1], image)

    schema = T.StructType(
        [T.StructField(k, T.LongType()) for k in [*keys, "look"]]
        + [T.StructField(k, T.IntegerType()) for k in ("az", "rg")]
        + [T.StructField(k, T.DoubleType()) for k in ("re", "im")]
    )
    last = int(starts[-1]) + per
    used = collect.pulses.where(
        (F.col("pulse") >= windows.first) & (F.col("pulse") < last)
    ).select(
        *[F.col(k).cast("bigint").alias(k) for k in keys],
        F.col("pulse").cast("bigint").alias("pulse"),
        "px", "py", "pz", "r_ref", "re", "im",
    )
    return used.mapInArrow(accumulate, schema)


def window_geometry(collect: Collect, grid: Grid, windows: PulseWindows) -> DataFrame:
    """Per look, the geometry an image inherits from its pulses.

    Only the first, middle and last pulse of each look are read.
    """
    meta = collect.meta
    start = F.least(F.col("id") * windows.step, F.lit(windows.n_pulse - windows.per)) + windows.first
    roles = (("first", 0), ("mid", windows.per // 2), ("last", windows.per - 1))
    places = F.array(*[
        F.struct((start + offset).alias("pulse"), F.lit(role).alias("role")) for role, offset in roles
    ])
    # Three rows per look.
    edges = collect.pulses.sparkSession.range(windows.n_looks).select(
        F.col("id").alias("look"), F.inline(places)
    )
    picked = collect.geometry.join(
        F.broadcast(edges), "pulse"
    )
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
    wide = picked.groupBy("look").agg(
        *[at(r, c) for r in ("first", "last") for c in ("t", "px", "py", "pz")],
        *[at("mid", c) for c in ("t", "pz", "r_ref")],
    )
    span = F.col("last_t") - F.col("first_t")
    flown = F.sqrt(
        sum((F.col(f"last_{c}") - F.col(f"first_{c}")) ** 2 for c in ("px", "py", "pz"))
    )
    r0 = F.when(F.col("mid_r_ref") > 0, F.col("mid_r_ref")).otherwise(meta.r_near)
    drop = F.abs(F.col("mid_pz") - grid.origin[2])
    located = wide.select(
        "look",
        F.col("first_t").alias("t0"),
        F.col("mid_t").alias("centre_time"),
        span.alias("t_dwell"),
        F.when(span > 0, flown / span).otherwise(0.0).alias("v_platform"),
        r0.alias("r0"),
        drop.alias("_drop"),
    )
    interval = F.when(
        (F.lit(grid.n_x) > 1) & (F.col("t_dwell") > 0), F.col("t_dwell") / (grid.n_x - 1)
    ).otherwise(1.0 / meta.prf if meta.prf > 0 else 0.0)
    return located.select(
        "look", "t0", "centre_time", "t_dwell", "v_platform", "r0",
        F.when(
            (F.col("r0") > 0) & (F.col("_drop") <= F.col("r0")),
            F.acos(F.col("_drop") / F.col("r0")),
        ).otherwise(0.0).alias("incidence"),
        interval.alias("azimuth_time_interval"),
    )


def image_meta(collect: Collect, grid: Grid, windows: PulseWindows) -> tuple[ImageMeta, list[float]]:
    """Geometry of the first look's image, and every look's centre time."""
    rows = window_geometry(collect, grid, windows).orderBy("look").collect()
    first, meta = rows[0], collect.meta
    interval = first["azimuth_time_interval"]
    image = ImageMeta(
        n_az=grid.n_x,
        n_rg=grid.n_y,
        fs_az=1.0 / interval if interval > 0 else 0.0,
        azimuth_time_interval=interval,
        fc=meta.fc,
        wavelength=meta.wavelength,
        az_spacing=grid.dx,
        rg_spacing=grid.dy,
        r0=first["r0"],
        t0=first["t0"],
        t_dwell=first["t_dwell"],
        incidence=first["incidence"],
        v_platform=first["v_platform"],
        pulse_prf=meta.prf,
        plane=meta.plane,
        source=f"backprojected/{meta.source or 'cphd'}",
    )
    return image, [r["centre_time"] for r in rows]


def azimuth_resolutions(collect: Collect, pulse_count: int | None = None) -> DataFrame:
    """Azimuth resolution of an image formed from the first pulses, for every count (or one): ``(pulse_count, resolution)``.

    The middle pulse of each count is found by an equi-join; the first pulse is a single row.
    """
    track = collect.geometry.select("pulse", "px", "py", "pz", "r_ref")
    last = track.where(F.col("pulse") >= 1 if pulse_count is None else F.col("pulse") == pulse_count - 1)
    first = track.where("pulse = 0").select(F.struct("px", "py", "pz").alias("_first"))
    middle = track.select(F.col("pulse").alias("_mid"), F.col("r_ref").alias("_centre"))
    apart = lambda c: F.pow(F.col(c) - F.col(f"_first.{c}"), 2)
    joined = (
        last.withColumn("pulse_count", F.col("pulse") + 1).withColumn("_mid", F.floor(F.col("pulse_count") / 2))
        .join(middle, "_mid").crossJoin(F.broadcast(first))
        .withColumn("_chord", F.sqrt(apart("px") + apart("py") + apart("pz")))
        .withColumn("_range", F.when(F.col("_centre") > 0, F.col("_centre")).otherwise(F.lit(float(collect.meta.r_near))))
    )
    known = (F.col("_chord") > 0) & (F.col("_range") > 0) & F.lit(collect.meta.wavelength > 0)
    formula = F.lit(float(collect.meta.wavelength)) * F.col("_range") / (2.0 * F.col("_chord"))
    return joined.select("pulse_count", F.when(known, formula).otherwise(0.0).alias("resolution"))


def focus_azimuth_resolution(collect: Collect, pulse_count: int) -> float:
    """Azimuth resolution of an image formed from the first ``pulse_count`` pulses."""
    meta = collect.meta
    count = min(pulse_count, meta.n_pulse)
    if count < 2 or meta.wavelength <= 0:
        return 0.0
    return azimuth_resolutions(collect, count).first()["resolution"]
