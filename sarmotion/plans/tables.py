"""The shared tables seen as radar data.

``events`` become motion windows (one per user, 64 looks over the table's whole time
span), ``embeddings`` become pulses, image columns or films of small complex images,
and the relational tables become geometry rows.  Every row of a table is used.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.focus import Collect
from ..operators.spectrum import pack_series
from ..operators.subaperture import ImageStack
from ..params import (
    SPEED_OF_LIGHT,
    CollectMeta,
    Grid,
    ImageMeta,
    MotionMeta,
    StackMeta,
)

EVENT_LOOKS = 64
WINDOWS_PER_ROW = 15
EVENT_META = MotionMeta(
    n_looks=EVENT_LOOKS, dt=0.25, n_win_az=0, n_win_rg=WINDOWS_PER_ROW, f_max=2.0,
    t_sap=0.4, az_spacing=1.0, rg_spacing=0.5, quant_px=60.0,
)

FILM_LOOKS = 64
FILM_AZ, FILM_RG = 8, 4
FILM_IMAGE = ImageMeta(
    n_az=FILM_AZ, n_rg=FILM_RG, fs_az=8.0, azimuth_time_interval=0.125, fc=9.6e9,
    wavelength=SPEED_OF_LIGHT / 9.6e9, az_spacing=1.0, rg_spacing=1.0, r0=600000.0,
    t_dwell=1.0, v_platform=7500.0,
)
FILM_META = StackMeta(n_looks=FILM_LOOKS, image=FILM_IMAGE, dt=0.25, f_max=2.0, t_sap=0.4)

COLUMN_LINES = 32
COLUMN_RATE = 32.0

PULSE_BINS = 32
PULSE_PRF = 100.0
PULSE_META = CollectMeta(
    n_pulse=0, n_rbin=PULSE_BINS, dr=1.0, fc=9.6e9, wavelength=0.03125, prf=PULSE_PRF,
    phase_ref_srp=True,
)
PULSE_GRID = Grid(n_x=8, n_y=8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Wall-clock microseconds since 1970, whatever the session's time zone."""
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    seconds = (F.expr(f"extract(SECOND FROM {ts})") * 1000000).cast("bigint")
    return (days * 86400 + clock) * F.lit(1000000).cast("bigint") + seconds


def event_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value and count per user and time slot.

    Aggregation is partial before the shuffle, so a user owning a third of all
    events still sends at most 64 rows per task.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("win"), micros("ts").alias("us"), "value"
    )
    span = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    slot = F.expr(f"((us - lo) * {EVENT_LOOKS}) div (hi - lo + 1)").cast("int")
    placed = events.crossJoin(F.broadcast(span)).select("win", slot.alias("look"), "value")
    return placed.groupBy("win", "look").agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("c")
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series form of the event windows; quality is the share of slots filled."""
    # Only the two measured columns are gathered; the rest are multiples of them.
    series = pack_series(event_slots(spark, sf_dir), EVENT_LOOKS, columns=("v", "c"), carry=())
    scaled = lambda k: F.transform("v", lambda x: x * F.lit(k))
    filled = F.size(F.filter("c", lambda c: c > 0))
    return series.select(
        "win",
        F.floor(F.col("win") / WINDOWS_PER_ROW).cast("int").alias("iaz"),
        (F.col("win") % WINDOWS_PER_ROW).cast("int").alias("irg"),
        (filled / F.lit(float(EVENT_LOOKS))).alias("quality"),
        F.col("v").alias("disp_az"), F.col("c").alias("disp_rg"),
        scaled(0.01).alias("vel_los"), scaled(0.001).alias("disp_los"), scaled(0.0).alias("phase"),
    )


def film_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as films of 64 looks: ``(film, label, look, az, rg, re, im)``.

    Consecutive floats are real and imaginary parts of an 8 x 4 image.
    """
    vectors = table(spark, sf_dir, "embeddings")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(FILM_AZ * FILM_RG - 1)),
        lambda i: F.struct(
            F.floor(i / FILM_RG).cast("int").alias("az"), (i % FILM_RG).alias("rg"),
            F.element_at("embedding", 2 * i + 1).cast("double").alias("re"),
            F.element_at("embedding", 2 * i + 2).cast("double").alias("im"),
        ),
    )
    return vectors.select(
        F.floor(F.col("vec_id") / FILM_LOOKS).alias("film"), "label",
        (F.col("vec_id") % FILM_LOOKS).alias("look"), F.inline(cells),
    )


def film_stack(spark: SparkSession, sf_dir: str) -> ImageStack:
    pixels = film_pixels(spark, sf_dir).drop("label")
    return ImageStack(pixels, FILM_META)


def image_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as range columns of a 32-line image: ``(rg, label, re[], im[])``."""
    take = lambda offset: F.transform(
        F.sequence(F.lit(0), F.lit(COLUMN_LINES - 1)),
        lambda i: F.element_at("embedding", 2 * i + offset).cast("double"),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("rg"), "label", take(1).alias("re"), take(2).alias("im")
    )


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = image_columns(spark, sf_dir)
    return columns.select("rg", F.posexplode(F.arrays_zip("re", "im")).alias("az", "_v")).select(
        "az", "rg", "_v.re", "_v.im"
    )


def pulse_table(spark: SparkSession, sf_dir: str) -> Collect:
    """Embeddings as pulses of 32 range bins along a straight track."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    t = F.col("vec_id") / PULSE_PRF
    columns = image_columns(spark, sf_dir).select(F.col("rg").alias("vec_id"), "re", "im")
    px = 75.0 * (t - F.lit(n / PULSE_PRF / 2.0))
    pulses = columns.select(
        F.col("vec_id").alias("pulse"), t.alias("t"), px.alias("px"),
        F.lit(3500.0).alias("py"), F.lit(5000.0).alias("pz"),
        F.sqrt(px * px + 3500.0 * 3500.0 + 5000.0 * 5000.0).alias("r_ref"), "re", "im",
    )
    return Collect(pulses, replace(PULSE_META, n_pulse=n))


def geometry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as acquisition geometry, one row each."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (100.0 + 10.0 * F.sqrt("l_extendedprice")).alias("v"),
        (F.col("l_quantity") * 10.0 - 20.0).alias("f"),
        (400000.0 + 1500.0 * F.sqrt("l_extendedprice")).alias("slant"),
        (0.2 + F.col("l_discount") * 5.0).alias("theta"),
        (1.0 + F.col("l_quantity")).alias("dwell"),
        (F.col("l_tax") * 10.0).alias("overlap"),
    )
