"""Scenes for the tests: pulses are generated in parallel, one row per pulse."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sarmotion.errors import ArgumentError
from sarmotion.operators.focus import Collect
from sarmotion.params import SPEED_OF_LIGHT, CollectMeta, ImageMeta, Target
from sarmotion.sources.binary import PULSE_ARROW, PULSE_SCHEMA, list_column

def _echo(position, t, r_ref, targets, n_rbin, dr, wavelength, sigma, support, relative):
    """Range lines of pulses at ``position`` (n, 3) looking at point targets."""
    n = len(t)
    lines = np.zeros((n, n_rbin), np.complex128)
    k = 4.0 * math.pi / wavelength
    reach = int(math.ceil(support)) + 1
    offsets = np.arange(-reach, reach + 1)
    rows = np.arange(n)[:, None]
    for g in targets:
        lift = g.vib_amp * np.sin(2.0 * math.pi * g.vib_freq * t + g.vib_phase)
        where = np.stack([np.full(n, g.x), np.full(n, g.y), g.z + lift], axis=1)
        dist = np.linalg.norm(position - where, axis=1)
        fbin = (dist - r_ref) / dr + 0.5 * n_rbin
        phase = -k * (dist - r_ref if relative else dist) + g.phase
        bins = np.floor(fbin).astype(np.int64)[:, None] + offsets
        d = bins - fbin[:, None]
        shape = np.where(np.abs(d) <= support, np.exp(-0.5 * (d / sigma) ** 2), 0.0)
        inside = (bins >= 0) & (bins < n_rbin) & ((fbin >= 0) & (fbin < n_rbin))[:, None]
        value = g.rcs * np.exp(1j * phase)[:, None] * np.where(inside, shape, 0.0)
        np.add.at(lines, (rows, np.clip(bins, 0, n_rbin - 1)), value)
    return lines


def simulate(
    spark: SparkSession,
    targets: Sequence[Target],
    dwell: float = 20.0,
    prf: float = 400.0,
    n_rbin: int = 256,
    dr: float = 0.5,
    fc: float = 9.6e9,
    velocity: float = 7500.0,
    ground_range: float = 350000.0,
    altitude: float = 500000.0,
    partitions: int | None = None,
) -> Collect:
    """A straight pass over point targets; range phase is absolute."""
    n_pulse = int(prf * dwell)
    if n_pulse < 2 or n_rbin < 2:
        raise ArgumentError("a collect needs at least two pulses and two range bins")
    wavelength = SPEED_OF_LIGHT / fc
    targets = list(targets)
    sigma = 1.0 / 2.355 / dr  # a 1 m wide response, in bins

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pulse = np.asarray(batch.column(0))
            t = pulse / prf
            position = np.stack(
                [velocity * (t - 0.5 * dwell), np.full(len(t), ground_range),
                 np.full(len(t), altitude)], axis=1,
            )
            r_ref = np.linalg.norm(position, axis=1)
            signal = _echo(position, t, r_ref, targets, n_rbin, dr, wavelength,
                           sigma, 4.0 * sigma, False)
            columns = [pulse, t, *position.T, r_ref]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns]
                + [list_column(signal.real), list_column(signal.imag)],
                schema=PULSE_ARROW,
            )

    ids = spark.range(0, n_pulse, 1, partitions or spark.sparkContext.defaultParallelism)
    r_mid = math.hypot(ground_range, altitude)
    meta = CollectMeta(
        n_pulse=n_pulse, n_rbin=n_rbin, dr=dr, fc=fc, wavelength=wavelength, prf=prf,
        r_near=r_mid - 0.5 * n_rbin * dr, phase_ref_srp=False, source="simulated",
    )
    return Collect(ids.mapInArrow(lines, PULSE_SCHEMA), meta)


def clutter(n: int, half_extent: float, mean_rcs: float = 0.30, seed: int = 1) -> list[Target]:
    """Rayleigh-amplitude scatterers spread evenly over a square."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-half_extent, half_extent, size=(n, 2))
    amp = mean_rcs * np.sqrt(2.0 / math.pi) * np.sqrt(-2.0 * np.log(rng.uniform(1e-12, 1.0, n)))
    return [Target(float(x), float(y), 0.0, float(a)) for (x, y), a in zip(xy, amp)]


def truth(spark: SparkSession, targets: Sequence[Target]) -> DataFrame:
    """What was injected, one row per target."""
    rows = [(t.x, t.y, t.z, t.rcs, t.vib_freq, t.vib_amp, t.vib_phase) for t in targets]
    names = ("x", "y", "z", "rcs", "vib_freq", "vib_amp", "vib_phase")
    return spark.createDataFrame(
        [tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names)
    )


def static_like(
    collect: Collect,
    seeds: Sequence[int],
    n_target: int = 400,
    centre: tuple[float, float] = (0.0, 0.0),
    extent: float = 300.0,
    n_rbin: int = 0,
) -> Collect:
    """Motionless Rayleigh scenes seen along a real collect's own track.

    One realisation per seed, told apart by a ``trial`` column.  Range phase is
    written relative to ``r_ref``, as the metadata says.
    """
    meta = collect.meta
    n_target = n_target or 400
    extent = extent if extent > 0 else 300.0
    bins = n_rbin if 0 < n_rbin <= meta.n_rbin else meta.n_rbin
    bins = max(bins, 16)
    wavelength = SPEED_OF_LIGHT / meta.fc if meta.fc > 0 else meta.wavelength
    sigma = 2.0 / 2.355
    scenes = {}
    for trial, seed in enumerate(seeds):
        rng = np.random.default_rng(seed)
        xy = np.asarray(centre) + rng.uniform(-extent, extent, size=(n_target, 2))
        amp = np.sqrt(-2.0 * np.log(rng.uniform(1e-12, 1.0, n_target)))
        phase = rng.uniform(0.0, 2.0 * math.pi, n_target)
        scenes[trial] = [Target(x, y, 0.0, a, phase=p) for (x, y), a, p in zip(xy, amp, phase)]
    schema = pa.schema([("trial", pa.int64()), *PULSE_ARROW])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pulse, t, px, py, pz = [np.asarray(batch.column(i)) for i in range(5)]
            position = np.stack([px, py, pz], axis=1)
            r_ref = np.sqrt((px - centre[0]) ** 2 + (py - centre[1]) ** 2 + pz**2)
            for trial, targets in scenes.items():
                signal = _echo(position, t, r_ref, targets, bins, meta.dr, wavelength,
                               sigma, 4.0, True)
                columns = [np.full(len(t), trial, np.int64), pulse, t, px, py, pz, r_ref]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns]
                    + [list_column(signal.real), list_column(signal.imag)],
                    schema=schema,
                )

    geometry = collect.pulses.select(
        F.col("pulse").cast("bigint"), "t", "px", "py", "pz"
    )
    pulses = geometry.mapInArrow(lines, "trial bigint, " + PULSE_SCHEMA)
    return Collect(
        pulses,
        CollectMeta(
            n_pulse=meta.n_pulse, n_rbin=bins, dr=meta.dr, fc=meta.fc,
            wavelength=wavelength, prf=meta.prf, r_near=meta.r_near,
            phase_ref_srp=True, plane=meta.plane, source="simulated-static",
        ),
    )


def simulate_image(
    spark: SparkSession, n: int = 256, vib_freq: float = 2.0, vib_amp_px: float = 2.0
) -> tuple[DataFrame, ImageMeta]:
    """A focused image of three Gaussian targets, the middle one moving along azimuth."""
    interval = 10.0 / n
    # Azimuth share, range share, amplitude, whether it moves.
    blobs = [(0.25, 0.30, 1.0, 0), (0.50, 0.50, 1.0, 1), (0.75, 0.70, 0.8, 0)]
    sigma = 1.5

    @pandas_udf("double")
    def envelope(az: pd.Series, rg: pd.Series) -> pd.Series:
        a, r = az.to_numpy(float), rg.to_numpy(float)
        total = np.zeros(len(a))
        for za, zr, amp, moves in blobs:
            shift = moves * vib_amp_px * np.sin(2 * np.pi * vib_freq * a * interval)
            da, dr = (a - (za * n + shift)) / sigma, (r - zr * n) / sigma
            near = (np.abs(da) <= 4.0) & (np.abs(dr) <= 4.0)
            total += np.where(near, amp * np.exp(-0.5 * (da**2 + dr**2)), 0.0)
        return pd.Series(total)

    cells = spark.range(n * n).select(
        F.floor(F.col("id") / n).cast("int").alias("az"), (F.col("id") % n).cast("int").alias("rg")
    )
    pixels = cells.select("az", "rg", envelope("az", "rg").alias("re"), F.lit(0.0).alias("im"))
    meta = ImageMeta(
        n_az=n, n_rg=n, fs_az=1.0 / interval, azimuth_time_interval=interval, fc=9.6e9,
        wavelength=SPEED_OF_LIGHT / 9.6e9, az_spacing=1.0, rg_spacing=1.0, r0=500000.0,
        t_dwell=10.0, v_platform=7500.0, source="simulated-image",
    )
    return pixels, meta
