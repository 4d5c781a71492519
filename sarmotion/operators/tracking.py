"""Displacement of image windows from look to look.

Pixels are sent to blocks of windows (with the halo the block needs) and to chunks
of looks (with the looks they are compared to), so every task holds a bounded cube
whatever the size of the image or the length of the stack.  The tasks return one
row per (window, look); the series are then finished with window functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..errors import ArgumentError, SarMotionError
from ..functions.joins import attach, sifted
from ..functions.ranks import medians, order_statistics
from ..params import MotionMeta, StackMeta, TrackParams
from ..session import cut_lineage
from .patches import check_surface, demean, register, splitband_shift
from .spectrum import SERIES
from .subaperture import ImageStack


def motion_meta(stack: StackMeta, params: TrackParams) -> MotionMeta:
    image = stack.image
    fits = 0 < params.win_az <= image.n_az and 0 < params.win_rg <= image.n_rg
    if not fits:
        raise ArgumentError(
            f"window {params.win_az}x{params.win_rg} does not fit image "
            f"{image.n_az}x{image.n_rg}"
        )
    stride_az, stride_rg = _strides(params)
    unquantised = params.estimator == "phase" or params.upsample_az == 0
    return MotionMeta(
        n_looks=stack.n_looks,
        dt=stack.dt,
        n_win_az=(image.n_az - params.win_az) // stride_az + 1,
        n_win_rg=(image.n_rg - params.win_rg) // stride_rg + 1,
        f_max=stack.f_max,
        t_sap=stack.t_sap,
        az_spacing=image.az_spacing,
        rg_spacing=image.rg_spacing,
        quant_px=0.0 if unquantised else 1.0 / params.upsample_az,
    )


def _strides(params: TrackParams) -> tuple[int, int]:
    return params.stride_az or params.win_az, params.stride_rg or params.win_rg


def _check(stack: ImageStack, params: TrackParams) -> None:
    if stack.meta.n_looks < 2:
        raise ArgumentError(f"tracking needs at least 2 looks, not {stack.meta.n_looks}")
    if params.estimator not in ("correlation", "phase", "splitband"):
        raise ArgumentError(f"unknown estimator {params.estimator!r}")
    if params.reference not in ("first", "adjacent", "lag", "pair"):
        raise ArgumentError(f"unknown reference {params.reference!r}")
    if params.reference == "pair":
        if stack.slave is None:
            raise ArgumentError("reference 'pair' needs a stack with slave bands")
        if params.estimator != "correlation":
            raise ArgumentError("reference 'pair' needs the correlation estimator")
    if params.exhaustive and params.estimator != "phase":
        check_surface(params.win_az, params.win_rg, params.upsample_az, params.upsample_rg)


def _covering(p: Column, length: int, step: int, count: int) -> Column:
    """ARRAY of the spans ``[i * step, i * step + length)``, i < count, holding a position."""
    lo = F.greatest(F.lit(0), F.ceil((p - length + 1) / step)).cast("int")
    hi = F.least(F.lit(count - 1), F.floor(p / step)).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi))


def _blocks(pixels: DataFrame, meta: MotionMeta, params: TrackParams) -> DataFrame:
    """Pixels with the blocks of windows they serve; overlap is only at block edges."""
    per = params.block_windows
    out = pixels
    for axis, win, stride, n_win in (
        ("az", params.win_az, _strides(params)[0], meta.n_win_az),
        ("rg", params.win_rg, _strides(params)[1], meta.n_win_rg),
    ):
        reach = (per - 1) * stride + win
        served = _covering(F.col(axis), reach, per * stride, -(-n_win // per))
        out = out.withColumn(f"b{axis}", F.explode(served))
    return out


def _block_windows(block_az: int, block_rg: int, meta: MotionMeta, params: TrackParams):
    """(iaz, irg) of a block's windows and their corners inside the block."""
    per, (stride_az, stride_rg) = params.block_windows, _strides(params)
    for iaz in range(block_az * per, min(meta.n_win_az, (block_az + 1) * per)):
        for irg in range(block_rg * per, min(meta.n_win_rg, (block_rg + 1) * per)):
            yield iaz, irg, (iaz - block_az * per) * stride_az, (irg - block_rg * per) * stride_rg


def _cube(pdf: pd.DataFrame, looks: np.ndarray, block_az: int, block_rg: int, params: TrackParams):
    """Dense (look, az, rg) array of a block's pixels."""
    per, (stride_az, stride_rg) = params.block_windows, _strides(params)
    shape = (len(looks), (per - 1) * stride_az + params.win_az, (per - 1) * stride_rg + params.win_rg)
    cube = np.zeros(shape, np.complex128)
    at = np.searchsorted(looks, pdf["look"].to_numpy())
    az = pdf["az"].to_numpy() - block_az * per * stride_az
    rg = pdf["rg"].to_numpy() - block_rg * per * stride_rg
    cube[at, az, rg] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    return cube


def _look_chunks(stack: ImageStack, params: TrackParams) -> DataFrame:
    """Pixels with the chunk of looks they are needed in, and in which role."""
    size, n_looks = params.looks_per_task, stack.meta.n_looks
    last = (n_looks - 1) // size
    look = F.col("look")
    own = F.floor(look / size).cast("int")
    master = stack.pixels.withColumn("slave", F.lit(False))
    if params.reference == "pair":
        both = stack.paired
        if both is None:
            both = master.unionByName(stack.slave.withColumn("slave", F.lit(True)))
        return both.withColumn("chunk", own)
    chunks = F.array(own)
    if params.reference in ("adjacent", "lag"):
        lag = _lag(params)
        later = F.floor((look + lag) / size).cast("int")
        chunks = F.when(look + lag < n_looks, F.array_distinct(F.array(own, later))).otherwise(chunks)
    # Look 0 is every chunk's phase reference.
    chunks = F.when(look == 0, F.sequence(F.lit(0), F.lit(last))).otherwise(chunks)
    return master.withColumn("chunk", F.explode(chunks))


def _lag(params: TrackParams) -> int:
    return max(params.ref_lag, 1) if params.reference == "lag" else 1


# Images that a film key may tell apart; it sizes a filter, not a result.
EXPECTED_FILMS = 64

_PAIR_FIELDS = (
    "iaz int, irg int, look bigint, shift_az double, shift_rg double, peak double, "
    "dot_re double, dot_im double"
)


def register_windows(stack: ImageStack, params: TrackParams, keys: Sequence[str] = ()) -> DataFrame:
    """Shift of every window at every look against its reference look.

    ``peak`` is NULL where a look has no reference (the first, or the first ``lag``).
    """
    keys = list(keys)
    meta = motion_meta(stack.meta, params)
    size, n_looks, lag = params.looks_per_task, stack.meta.n_looks, _lag(params)
    reference = params.reference

    def track_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *outer, block_az, block_rg, chunk = key
        current = np.arange(chunk * size, min(n_looks, (chunk + 1) * size))
        if reference == "pair":
            masters, slaves = pdf[~pdf["slave"]], pdf[pdf["slave"]]
            looks = current
            cube = _cube(masters, looks, block_az, block_rg, params)
            other = _cube(slaves, looks, block_az, block_rg, params)
            measured, ref_at = current, np.arange(len(current))
        else:
            if reference == "first":
                measured, refs = current[current > 0], np.zeros((current > 0).sum(), int)
            else:
                measured = current[current >= lag]
                refs = measured - lag
            # Looks the stack does not hold stay empty.
            looks = np.unique(np.concatenate([[0], current, refs]))
            cube = other = _cube(pdf, looks, block_az, block_rg, params)
            ref_at = np.searchsorted(looks, refs)
        cur_at = np.searchsorted(looks, measured)
        blank = np.setdiff1d(current, measured)
        parts = []
        for iaz, irg, a0, r0 in _block_windows(block_az, block_rg, meta, params):
            box = np.s_[:, a0 : a0 + params.win_az, r0 : r0 + params.win_rg]
            raw, raw_other = cube[box], other[box]
            if len(measured):
                az, rg, peak = register(
                    demean(raw[ref_at]), demean(raw_other[cur_at]),
                    params.upsample_az, params.upsample_rg, params.exhaustive,
                )
                anchor = raw[ref_at] if reference == "pair" else raw[:1]
                dot = (raw_other[cur_at] * np.conj(anchor)).sum(axis=(1, 2))
                parts.append(pd.DataFrame({
                    "iaz": iaz, "irg": irg, "look": measured, "shift_az": az,
                    "shift_rg": rg, "peak": peak, "dot_re": dot.real, "dot_im": dot.imag,
                }))
            if len(blank):
                parts.append(pd.DataFrame({
                    "iaz": iaz, "irg": irg, "look": blank, "shift_az": 0.0,
                    "shift_rg": 0.0, "peak": np.nan, "dot_re": 0.0, "dot_im": 0.0,
                }))
        out = pd.concat(parts, ignore_index=True)
        for name, value in zip(keys, outer):
            out[name] = value
        return out

    schema = ", ".join([f"{k} bigint" for k in keys] + [_PAIR_FIELDS])
    pairs = (
        _blocks(_look_chunks(stack, params), meta, params)
        .groupBy(*keys, "baz", "brg", "chunk")
        .applyInPandas(track_block, schema)
    )
    return pairs.withColumn("peak", F.nanvl("peak", F.lit(None).cast("double")))


_REGISTRY_FIELDS = (
    "iaz int, irg int, ref bigint, look bigint, shift_az double, shift_rg double, peak double, dot_re double, dot_im double"
)


def register_pairs(
    stack: ImageStack, params: TrackParams, pairs: Sequence[tuple[int, int]], keys: Sequence[str] = ()
) -> DataFrame:
    """Shift and phase product of every window for each (reference look, look) of ``pairs``, once each.

    A task holds a block's pixels of two chunks of looks at most.  Pixels go to each chunk that theirs is paired with,
    so what is shuffled follows the number of chunks, never the number of pairs.
    """
    keys = list(keys)
    meta = motion_meta(stack.meta, params)
    size = params.looks_per_task
    listed = sorted({(int(a), int(b)) for a, b in pairs})
    by_chunks: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for ref, look in listed:
        by_chunks.setdefault((ref // size, look // size), []).append((ref, look))
    meetings = sorted(by_chunks)
    n_chunk = (stack.meta.n_looks - 1) // size + 1
    attends = F.array(*[
        F.array(*[F.lit(i) for i, m in enumerate(meetings) if chunk in m]).cast("array<int>") for chunk in range(n_chunk)
    ])
    held = stack.pixels.sparkSession.sparkContext.broadcast([np.array(by_chunks[m]) for m in meetings])

    def register_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *outer, block_az, block_rg, meeting = key
        wanted = held.value[meeting]
        looks = np.unique(wanted)
        cube = _cube(pdf[np.isin(pdf["look"].to_numpy(), looks)], looks, block_az, block_rg, params)
        ref_at, cur_at = (np.searchsorted(looks, wanted[:, k]) for k in (0, 1))
        parts = []
        for iaz, irg, a0, r0 in _block_windows(block_az, block_rg, meta, params):
            raw = cube[:, a0 : a0 + params.win_az, r0 : r0 + params.win_rg]
            level = demean(raw)
            az, rg, peak = register(
                level[ref_at], level[cur_at], params.upsample_az, params.upsample_rg, params.exhaustive)
            dot = (raw[cur_at] * np.conj(raw[ref_at])).sum(axis=(1, 2))
            parts.append(pd.DataFrame({
                "iaz": iaz, "irg": irg, "ref": wanted[:, 0], "look": wanted[:, 1], "shift_az": az, "shift_rg": rg,
                "peak": peak, "dot_re": dot.real, "dot_im": dot.imag,
            }))
        out = pd.concat(parts, ignore_index=True)
        for name, value in zip(keys, outer):
            out[name] = value
        return out

    chunk = F.floor(F.col("look") / size).cast("int")
    placed = stack.pixels.withColumn("meeting", F.explode(F.get(attends, chunk)))
    return (
        _blocks(placed, meta, params).groupBy(*keys, "baz", "brg", "meeting")
        .applyInPandas(register_block, ", ".join([f"{k} bigint" for k in keys] + [_REGISTRY_FIELDS]))
    )


def track_trials(
    stack: ImageStack, params: TrackParams, trials: Sequence[tuple[int, int, int]], keys: Sequence[str] = ()
) -> tuple[DataFrame, MotionMeta]:
    """Motion of every re-ordering of the looks, ``(trial, look, placed_at)`` rows, with ``trial`` among the keys.

    Each distinct pair of looks is registered once; trials are look-ups in that registry.
    """
    _check(stack, params)
    if params.estimator != "correlation" or params.reference == "pair":
        raise ArgumentError("only the correlation estimator of single looks registers pairs")
    keys = list(keys)
    meta = motion_meta(stack.meta, params)
    behind = stack.meta.n_looks if params.reference == "first" else _lag(params)
    order: dict[int, dict[int, int]] = {}
    for trial, look, at in trials:
        order.setdefault(trial, {})[at] = look
    # (trial, place, look, reference, whether the shift counts, whether the phase does)
    roles, blank = [], []
    for trial, placed in order.items():
        for at, look in placed.items():
            before = (0 if at else None) if params.reference == "first" else (at - behind if at >= behind else None)
            ref, first = placed.get(before), placed.get(0)
            if before is None or ref is None:
                blank.append((trial, at))
                continue
            roles.append((trial, at, look, ref, True, ref == first))
            if ref != first and first is not None:
                roles.append((trial, at, look, first, False, True))
    pairs = {(ref, look) for _, _, look, ref, _, _ in roles}
    found = register_pairs(stack, params, pairs, keys)
    # A place without a reference rides on any pair, of which every window has all.
    anchor = min(pairs)
    roles += [(trial, at, anchor[1], anchor[0], False, False) for trial, at in blank]
    # At most twice trials x looks rows.
    table = F.broadcast(stack.pixels.sparkSession.createDataFrame(
        roles, "trial bigint, at bigint, look bigint, ref bigint, shifts boolean, turns boolean"))
    joined = found.join(table, ["look", "ref"])
    peak = F.when(F.col("shifts"), F.nanvl("peak", F.lit(None).cast("double")))
    values = [F.when(F.col("shifts"), F.col(x)).otherwise(0.0).alias(x) for x in ("shift_az", "shift_rg")]
    values += [peak.alias("peak"), *[F.when(F.col("turns"), F.col(x)).otherwise(0.0).alias(x) for x in ("dot_re", "dot_im")]]
    pairs = joined.select(*keys, "trial", "iaz", "irg", F.col("at").alias("look"), *values)
    if params.reference != "first":
        names = ("shift_az", "shift_rg", "peak", "dot_re", "dot_im")
        pairs = pairs.groupBy(*keys, "trial", "iaz", "irg", "look").agg(*[F.sum(x).alias(x) for x in names])
    keyed = [*keys, "trial"]
    return _finished(_finish_correlation(pairs, stack.meta, params, keyed), stack, params, meta, keyed), meta


def _finish_correlation(pairs: DataFrame, stack: StackMeta, params: TrackParams, keys: list[str]) -> DataFrame:
    image = stack.image
    whole = Window.partitionBy(*keys, "iaz", "irg")
    measured = F.col("peak").isNotNull()
    if params.reference == "adjacent":
        pairs = pairs.withColumns({c: accumulated(c, whole.orderBy("look")) for c in ("shift_az", "shift_rg")})
    phase = F.when(measured, F.atan2("dot_im", "dot_re")).otherwise(0.0)
    moved = pairs.withColumn("phase", phase).withColumns({
        "quality": F.coalesce(F.avg("peak").over(whole), F.lit(0.0)),
        "_mean": F.atan2(
            F.sum(F.sin("phase")).over(whole), F.sum(F.cos("phase")).over(whole)
        ),
    })
    turn = F.col("phase") - F.col("_mean")
    psi = F.atan2(F.sin(turn), F.cos(turn))
    return moved.select(
        *keys, "iaz", "irg", "look",
        F.when(measured, F.col("shift_az")).otherwise(0.0).alias("disp_az"),
        F.when(measured, F.col("shift_rg")).otherwise(0.0).alias("disp_rg"),
        F.when(measured, velocity(F.col("shift_az"), stack)).otherwise(0.0).alias("vel_los"),
        (-_wavelength(image) / (4.0 * math.pi) * psi).alias("disp_los"),
        "phase", "quality",
    )


def accumulated(column: str, along: WindowSpec) -> Column:
    """Shifts from look to look as shifts from the first."""
    return F.sum(column).over(along.rowsBetween(Window.unboundedPreceding, 0))


def rate(column: str, along: WindowSpec, dt: float) -> Column:
    """Change since the look before, a second; 0 at the first look and without a look step."""
    if not dt > 0:
        return F.lit(0.0)
    return F.coalesce((F.col(column) - F.lag(column).over(along)) / dt, F.lit(0.0))


def velocity(shift: Column, stack: StackMeta) -> Column:
    """Line-of-sight velocity an azimuth shift stands for; 0 without the geometry."""
    image = stack.image
    if image.az_spacing > 0 and image.v_platform > 0 and image.r0 > 0:
        return shift * (image.az_spacing * image.v_platform / image.r0)
    return F.lit(0.0)


def _wavelength(image) -> float:
    return image.wavelength if image.wavelength > 0 else 0.031


def track_phase(stack: ImageStack, params: TrackParams, keys: Sequence[str] = ()) -> DataFrame:
    """Phase of each window's brightest pixel, relative to its mean over looks."""
    keys = list(keys)
    meta = motion_meta(stack.meta, params)
    stride_az, stride_rg = _strides(params)
    near = stack.pixels.where(F.col("look") == 0)
    tiled = near.withColumn(
        "iaz", F.explode(_covering(F.col("az"), params.win_az, stride_az, meta.n_win_az))
    ).withColumn(
        "irg", F.explode(_covering(F.col("rg"), params.win_rg, stride_rg, meta.n_win_rg))
    )
    # Brightness is judged after removing the window's complex mean.
    mean = tiled.groupBy(*keys, "iaz", "irg").agg(
        F.avg("re").alias("_mre"), F.avg("im").alias("_mim")
    )
    size = F.hypot(F.col("re") - F.col("_mre"), F.col("im") - F.col("_mim"))
    best = (
        tiled.join(mean, [*keys, "iaz", "irg"])
        .groupBy(*keys, "iaz", "irg")
        .agg(F.max(F.struct(size.alias("a"), (-F.col("az")).alias("az"), (-F.col("rg")).alias("rg"))).alias("_b"))
        .select(*keys, "iaz", "irg", (-F.col("_b.az")).alias("az"), (-F.col("_b.rg")).alias("rg"))
    )
    # One pixel of each window is wanted, so the others of the stack are dropped before it is shuffled.
    near_best = sifted(stack.pixels, best, [*keys, "az", "rg"], EXPECTED_FILMS * meta.n_win_az * meta.n_win_rg)
    series = best.join(near_best, [*keys, "az", "rg"])
    whole = Window.partitionBy(*keys, "iaz", "irg")
    along = whole.orderBy("look")
    amp = F.hypot("re", "im")
    held = series.withColumns({
        "_mean": F.atan2(F.sum("im").over(whole), F.sum("re").over(whole)),
        "_amp": F.avg(amp).over(whole),
        "_var": F.avg(amp * amp).over(whole),
    })
    turn = F.atan2("im", "re") - F.col("_mean")
    silent = (F.col("re") == 0) & (F.col("im") == 0)
    psi = F.when(silent, 0.0).otherwise(F.atan2(F.sin(turn), F.cos(turn)))
    spread = F.greatest(F.col("_var") - F.col("_amp") * F.col("_amp"), F.lit(0.0))
    quality = F.when(
        F.col("_amp") > 0,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.sqrt(spread) / F.col("_amp"))),
    ).otherwise(0.0)
    moved = held.withColumns({"phase": psi, "quality": quality}).withColumn(
        "disp_los", F.col("phase") * (-_wavelength(stack.meta.image) / (4.0 * math.pi))
    )
    return moved.select(
        *keys, "iaz", "irg", "look",
        F.lit(0.0).alias("disp_az"), F.lit(0.0).alias("disp_rg"),
        rate("disp_los", along, stack.meta.dt).alias("vel_los"), "disp_los", "phase", "quality",
    )


def track_splitband(stack: ImageStack, params: TrackParams, keys: Sequence[str] = ()) -> DataFrame:
    """Azimuth shifts from the phase between two thirds of each window's band.

    The estimator couples every look of a window, so one task holds one block's whole stack and a looks x looks
    coherence matrix: ``n_looks`` times a block's pixels plus ``n_looks`` squared complex numbers.  The number of
    looks is a parameter of the split; ``block_windows`` sets the block.  ``converged`` tells whether the phases
    of both sub-bands settled.
    """
    keys = list(keys)
    n_looks = stack.meta.n_looks
    meta = motion_meta(stack.meta, params)

    def track_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *outer, block_az, block_rg = key
        looks = np.arange(n_looks)
        cube = _cube(pdf, looks, block_az, block_rg, params)
        parts = []
        for iaz, irg, a0, r0 in _block_windows(block_az, block_rg, meta, params):
            patch = cube[:, a0 : a0 + params.win_az, r0 : r0 + params.win_rg]
            try:
                shift, coherence, settled = splitband_shift(demean(patch))
            except SarMotionError:
                # A window whose band cannot be split carries no motion.
                shift, coherence, settled = np.zeros(n_looks), 0.0, True
            parts.append(pd.DataFrame({
                "iaz": iaz, "irg": irg, "look": looks, "disp_az": shift, "quality": coherence,
                "converged": settled,
            }))
        out = pd.concat(parts, ignore_index=True)
        for name, value in zip(keys, outer):
            out[name] = value
        return out

    schema = ", ".join(
        [f"{k} bigint" for k in keys]
        + ["iaz int, irg int, look bigint, disp_az double, quality double, converged boolean"]
    )
    moved = _blocks(stack.pixels, meta, params).groupBy(*keys, "baz", "brg").applyInPandas(
        track_block, schema
    )
    return moved.select(
        *keys, "iaz", "irg", "look", "disp_az", F.lit(0.0).alias("disp_rg"),
        velocity(F.col("disp_az"), stack.meta).alias("vel_los"),
        F.lit(0.0).alias("disp_los"), F.lit(0.0).alias("phase"), "quality", "converged",
    )


def mask_incoherent(motion: DataFrame, params: TrackParams) -> DataFrame:
    """Zero the series of windows below the coherence gate; quality is kept."""
    if params.coherence_min <= 0:
        return motion
    low = F.col("quality") < params.coherence_min
    zeroed = ["disp_az", "disp_rg", "vel_los", "disp_los"]
    if params.estimator == "phase":
        zeroed = ["vel_los", "disp_los", "phase"]
    return motion.withColumns({c: F.when(low, 0.0).otherwise(F.col(c)) for c in zeroed})


def remove_common_mode(motion: DataFrame, stack: StackMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Subtract, look by look, the median displacement over all windows."""
    bounded = not keys  # then there is one row per look, and looks are a parameter
    keys = [*keys, "look"]
    axes = ("disp_az", "disp_rg")
    # Read three times below, and dear to make again: it is kept in reliable storage.
    motion = cut_lineage(motion)
    long = motion.select(*keys, F.explode(F.create_map(
        *[x for c in axes for x in (F.lit(c), F.col(c))]
    )).alias("_axis", "_shift"))
    middle = order_statistics(long, [*keys, "_axis"], "_shift", medians(), bounded)
    centre = middle.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_axis") == c, 0.5 * (F.col("mid_lo") + F.col("mid_hi")))).alias(f"_{c}")
        for c in axes
    ])
    joined = attach(motion, centre, keys, bounded)
    out = joined.withColumns({c: F.col(c) - F.col(f"_{c}") for c in axes}).drop(*[f"_{c}" for c in axes])
    image = stack.image
    if image.az_spacing > 0 and image.v_platform > 0 and image.r0 > 0:
        out = out.withColumn("vel_los", velocity(F.col("disp_az"), stack))
    return out


def track(stack: ImageStack, params: TrackParams, keys: Sequence[str] = ()) -> tuple[DataFrame, MotionMeta]:
    """Motion series ``(*keys, win, iaz, irg, look, <series>, quality)``."""
    _check(stack, params)
    keys = list(keys)
    meta = motion_meta(stack.meta, params)
    if params.estimator == "phase":
        moved = track_phase(stack, params, keys)
    elif params.estimator == "splitband":
        moved = track_splitband(stack, params, keys)
    else:
        moved = _finish_correlation(register_windows(stack, params, keys), stack.meta, params, keys)
    return _finished(moved, stack, params, meta, keys), meta


def _finished(moved: DataFrame, stack: ImageStack, params: TrackParams, meta: MotionMeta, keys: list[str]) -> DataFrame:
    """Gates, common mode and window numbers, whatever made the series."""
    moved = mask_incoherent(moved, params)
    if params.remove_common_mode and meta.n_win > 2:
        moved = remove_common_mode(moved, stack.meta, keys)
    win = (F.col("iaz").cast("bigint") * meta.n_win_rg + F.col("irg")).alias("win")
    flags = ["converged"] if params.estimator == "splitband" else []
    return moved.select(*keys, win, "iaz", "irg", "look", *SERIES, "quality", *flags)
