"""Images and maps turned into display levels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.joins import attach
from ..functions.ranks import by_index, order_statistics
from ..params import ImageMeta

# 16 evenly spaced RGB anchors per palette.
PALETTES = {
    "viridis": (
        (68, 1, 84), (72, 26, 108), (71, 47, 125), (65, 68, 135),
        (57, 86, 140), (49, 104, 142), (42, 120, 142), (35, 136, 142),
        (31, 152, 139), (34, 168, 132), (53, 183, 121), (85, 198, 103),
        (122, 209, 81), (165, 219, 54), (210, 226, 27), (253, 231, 37),
    ),
    "energy": (
        (48, 18, 59), (65, 69, 171), (74, 117, 240), (70, 160, 253),
        (49, 198, 223), (34, 225, 190), (48, 243, 140), (96, 253, 89),
        (146, 255, 52), (188, 243, 42), (222, 220, 49), (247, 187, 49),
        (254, 145, 38), (241, 99, 22), (216, 60, 9), (165, 20, 2),
    ),
    "jet": (
        (0, 0, 143), (0, 0, 207), (0, 0, 255), (0, 63, 255),
        (0, 127, 255), (0, 191, 255), (38, 255, 214), (93, 255, 159),
        (159, 255, 93), (214, 255, 38), (255, 208, 0), (255, 145, 0),
        (255, 81, 0), (255, 18, 0), (207, 0, 0), (143, 0, 0),
    ),
}


def palette_from_name(name: str | None, fallback: str = "viridis") -> str:
    if not name:
        return fallback
    if name in ("gray", "grey"):
        return "gray"
    return name if name in PALETTES else fallback


def _unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def level(v: Column) -> Column:
    """A [0, 1] value as an 8-bit level, halves up."""
    return F.floor(_unit(v) * 255.0 + 0.5).cast("int")


def quicklook(image: DataFrame, dynamic_range_db: float = 40.0, keys: Sequence[str] = ()) -> DataFrame:
    """Amplitude in decibels below its 99th percentile: ``(*keys, az, rg, level)``."""
    span = dynamic_range_db if dynamic_range_db > 0 else 40.0
    keys = list(keys)
    sized = image.select(*keys, "az", "rg", F.hypot("re", "im").alias("amp"))
    white = order_statistics(sized, keys, "amp", {"white": by_index(0.99)}).select(*keys, "white")
    joined = attach(sized, white, keys)
    bright = (F.col("white") > 0) & (F.col("amp") > 0)
    share = 1.0 + 20.0 * (F.log10("amp") - F.log10("white")) / span
    shade = level(F.when(bright, share).otherwise(0.0))
    return joined.select(*keys, "az", "rg", shade.alias("level"))


def map_levels(
    cells: DataFrame, value: str, lo: float = 0.0, hi: float = 0.0, palette: str = "gray"
) -> DataFrame:
    """A map on [lo, hi], or on its own finite range when they are equal.

    Non-finite cells take the lowest level.  Colour palettes add ``r, g, b``.
    """
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    if lo == hi:
        auto = cells.agg(
            F.coalesce(F.min(F.when(finite, v)), F.lit(0.0)).alias("_lo"),
            F.coalesce(F.max(F.when(finite, v)), F.lit(1.0)).alias("_hi"),
        )
        scaled = cells.crossJoin(F.broadcast(auto))
    else:
        scaled = cells.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    top = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1.0).otherwise(F.col("_hi"))
    share = _unit(F.when(finite, (v - F.col("_lo")) / (top - F.col("_lo"))).otherwise(0.0))
    out = scaled.withColumn("level", level(share))
    if palette != "gray":
        out = out.withColumns(dict(zip("rgb", colour(share, palette))))
    return out.drop("_lo", "_hi")


def colour(share: Column, palette: str) -> list[Column]:
    """Red, green and blue of a [0, 1] value, interpolated between anchors."""
    anchors = PALETTES.get(palette)
    if anchors is None:
        raise ArgumentError(f"unknown palette {palette!r}")
    at = _unit(share) * 15.0
    base = F.least(F.floor(at), F.lit(14)).cast("int")
    bands = []
    for k in range(3):
        table = F.array(*[F.lit(float(a[k])) for a in anchors])
        low, high = F.element_at(table, base + 1), F.element_at(table, base + 2)
        bands.append(F.floor(low + (at - base) * (high - low) + 0.5).cast("int"))
    return bands


def crop(
    image: DataFrame, meta: ImageMeta, az0: int, rg0: int, n_az: int, n_rg: int
) -> tuple[DataFrame, ImageMeta]:
    """A sub-rectangle, its range and timing re-derived from the corner."""
    if az0 >= meta.n_az or rg0 >= meta.n_rg or az0 < 0 or rg0 < 0:
        raise ArgumentError(f"crop origin ({az0},{rg0}) is outside the image")
    n_az, n_rg = min(n_az, meta.n_az - az0), min(n_rg, meta.n_rg - rg0)
    inside = F.col("az").between(az0, az0 + n_az - 1) & F.col("rg").between(rg0, rg0 + n_rg - 1)
    cut = image.where(inside).withColumns({"az": F.col("az") - az0, "rg": F.col("rg") - rg0})
    return cut, replace(
        meta, n_az=n_az, n_rg=n_rg,
        r0=meta.r0 + rg0 * meta.rg_spacing,
        t0=meta.t0 + az0 * meta.azimuth_time_interval,
        t_dwell=n_az * meta.azimuth_time_interval,
    )
