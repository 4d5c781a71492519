"""Where consecutive looks stop resembling each other.

A tile of pixels (with the halo its windows need) and a chunk of looks (with its
neighbours) are placed together by one shuffle.  Every moving sum after that is a
window function whose partition keys include the tile and chunk, so it sorts within
the partition and moves nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..params import CcdParams


def eigen_ratio(ax, dx, bx_re, bx_im, ay, dy, by_re, by_im, load) -> Column:
    """Largest over smallest eigenvalue of X Y^-1 for two 2x2 Hermitian matrices."""
    ax, dx, ay, dy = (F.col(c) + load for c in (ax, dx, ay, dy))
    br, bi, cr, ci = (F.col(c) for c in (bx_re, bx_im, by_re, by_im))
    det_x = ax * dx - (br * br + bi * bi)
    det_y = ay * dy - (cr * cr + ci * ci)
    trace = (ax * dy + dx * ay - 2.0 * (br * cr + bi * ci)) / det_y
    root = F.sqrt(F.greatest(trace * trace - 4.0 * det_x / det_y, F.lit(0.0)))
    high, low = 0.5 * (trace + root), 0.5 * (trace - root)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    ok = (det_y > 0) & finite(det_y)
    return F.when(ok & (low > 0) & finite(high) & finite(low), high / low).otherwise(1.0)


def _check(n_looks: int | None, n_az: int, n_rg: int, params: CcdParams) -> None:
    if n_looks is not None and n_looks < 3:
        raise ArgumentError(f"{n_looks} looks are too few; a triple needs three")
    if params.win <= 0:
        raise ArgumentError("the window must be positive")
    if params.statistic != "g12":
        raise ArgumentError("only the two-channel statistic is implemented")
    if params.win > n_az or params.win > n_rg:
        raise ArgumentError(f"a {params.win} window does not fit a {n_az}x{n_rg} image")


def _reach(position: Column, tile: int, halo: int, n: int) -> Column:
    """Tiles whose interior or halo holds a pixel."""
    last = (n - 1) // tile
    lo = F.greatest(F.floor((position - halo) / tile), F.lit(0)).cast("int")
    hi = F.least(F.floor((position + halo) / tile), F.lit(last)).cast("int")
    return F.sequence(lo, hi)


def triple_ratios(
    pixels: DataFrame, n_az: int, n_rg: int, params: CcdParams, n_looks: int | None = None
) -> DataFrame:
    """Change statistic per interior pixel and triple: ``(look, az, rg, ratio)``.

    ``look`` is the triple's middle look.
    """
    _check(n_looks, n_az, n_rg, params)
    half, size = params.win // 2, params.looks_per_task
    tail = params.win - 1 - half
    power = pixels.agg(F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("_power"))
    load = params.loading * params.win * params.win
    look, az, rg = F.col("look"), F.col("az"), F.col("rg")
    # A chunk computes triples centred on its own looks, so it also needs one either side.
    own = F.floor(look / size)
    chunk = F.filter(
        F.array_distinct(F.array(F.floor((look - 1) / size), own, F.floor((look + 1) / size))),
        lambda c: c >= 0,
    )
    placed = (
        pixels.select("look", "az", "rg", "re", "im", F.explode(chunk).alias("_chunk"))
        .withColumn("_ta", F.explode(_reach(az, params.tile, params.win, n_az)))
        .withColumn("_tr", F.explode(_reach(rg, params.tile, params.win, n_rg)))
        .repartition("_ta", "_tr", "_chunk")
    )
    place = ["_ta", "_tr", "_chunk"]
    over_look = Window.partitionBy(*place, "az", "rg").orderBy("look")
    # Each pixel's own power and its product with the next look, if that look exists.
    follows = F.lead("look").over(over_look) == look + 1
    nre, nim = F.lead("re").over(over_look), F.lead("im").over(over_look)
    paired = placed.select(
        *place, "look", "az", "rg",
        (F.col("re") ** 2 + F.col("im") ** 2).alias("p0"),
        F.when(follows, nre * nre + nim * nim).alias("p1"),
        F.when(follows, F.col("re") * nre + F.col("im") * nim).alias("br"),
        F.when(follows, F.col("im") * nre - F.col("re") * nim).alias("bi"),
    ).where(F.col("p1").isNotNull())
    terms = ["p0", "p1", "br", "bi"]
    box = paired
    for axis, other in (("rg", "az"), ("az", "rg")):
        along = (
            Window.partitionBy(*place, "look", other).orderBy(axis).rowsBetween(-half, tail)
        )
        box = box.select(
            *place, "look", "az", "rg", *[F.sum(c).over(along).alias(c) for c in terms]
        )
    prev = Window.partitionBy(*place, "az", "rg").orderBy("look")
    consecutive = F.lag("look").over(prev) == look - 1
    pair = box.select(
        *place, "look", "az", "rg", *terms,
        *[F.when(consecutive, F.lag(c).over(prev)).alias(f"x_{c}") for c in terms],
    )
    inside = (
        (F.floor(az / params.tile) == F.col("_ta"))
        & (F.floor(rg / params.tile) == F.col("_tr"))
        & (F.floor(look / size) == F.col("_chunk"))
        & az.between(half, n_az - half - 1)
        & rg.between(half, n_rg - half - 1)
        & F.col("x_p0").isNotNull()
    )
    loaded = pair.where(inside).crossJoin(F.broadcast(power))
    ratio = eigen_ratio(
        "x_p0", "x_p1", "x_br", "x_bi", "p0", "p1", "br", "bi", F.col("_power") * load
    )
    return loaded.select("look", "az", "rg", ratio.alias("ratio"))


def change_map(
    pixels: DataFrame, n_az: int, n_rg: int, params: CcdParams, n_looks: int | None = None
) -> DataFrame:
    """Mean statistic per pixel over all triples; 0 on the border. ``(az, rg, stat)``."""
    ratios = triple_ratios(pixels, n_az, n_rg, params, n_looks)
    mean = ratios.groupBy("az", "rg").agg(F.avg("ratio").alias("stat"))
    cells = pixels.sparkSession.range(n_az * n_rg).select(
        F.floor(F.col("id") / n_rg).cast("int").alias("az"),
        (F.col("id") % n_rg).cast("int").alias("rg"),
    )
    typed = mean.select(F.col("az").cast("int"), F.col("rg").cast("int"), "stat")
    return cells.join(typed, ["az", "rg"], "left").select(
        "az", "rg", F.coalesce("stat", F.lit(0.0)).alias("stat")
    )


def map_range(change: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, mean and maximum of the positive statistics."""
    return change.where(F.col("stat") > 0).groupBy(*keys).agg(
        F.min("stat").alias("lo"), F.avg("stat").alias("mean"), F.max("stat").alias("hi")
    )
