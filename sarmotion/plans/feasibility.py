"""Vibration reach against image resolution, before any data are processed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

# The look counts the table reports.
LOOK_COUNTS = (8, 16, 32, 64, 128, 300)


def feasibility(acquisitions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Six rows per acquisition, from columns dwell, slant, speed and wavelength."""
    counts = F.array(*[F.lit(n) for n in LOOK_COUNTS])
    rows = acquisitions.select(
        *keys, "dwell", "slant", "speed", "wavelength", F.explode(counts).alias("n_looks")
    ).withColumn("dt", F.col("dwell") / F.col("n_looks"))
    return rows.select(
        *keys, "n_looks", "dt",
        g.vibration_fmax("n_looks", "dwell").alias("f_max"),
        g.azimuth_resolution("wavelength", "slant", "speed", "dt").alias("az_resolution"),
    )


def acquisition(
    spark: SparkSession, dwell: float, slant: float, speed: float, wavelength: float
) -> DataFrame:
    """One acquisition as the row ``feasibility`` reads."""
    return spark.createDataFrame(
        [(float(dwell), float(slant), float(speed), float(wavelength))],
        "dwell double, slant double, speed double, wavelength double",
    )


def depth_chain(
    acquisitions: DataFrame, velocity: float, frequency: float, keys: Sequence[str] = ()
) -> DataFrame:
    """What two assumed constants would do to a depth axis."""
    paper = g.acoustic_wavelength(velocity, frequency, "paper")
    aperture = g.orbital_aperture("speed", "dwell")
    return acquisitions.select(
        *keys,
        aperture.alias("aperture"),
        paper.alias("lambda_paper"),
        g.acoustic_wavelength(velocity, frequency, "patent").alias("lambda_patent"),
        g.depth_resolution(paper, "slant", aperture).alias("depth_resolution"),
    )
