"""The seven commands as plans over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError, RangeFault
from ..functions import geodesy
from ..operators import ccd, nulls, selection, tomography, validation
from ..operators.focus import Collect, backproject, full_aperture, image_meta
from ..operators.spectrum import pack_series, spectrum
from ..operators.subaperture import (
    ImageStack,
    azimuth_power_spectrum,
    build,
    doppler_bandwidth,
    doppler_centroid,
    pack_columns,
    paired_stack,
    pulse_windows,
)
from ..operators.tracking import track
from ..params import (
    CcdParams,
    Grid,
    ImageMeta,
    MotionMeta,
    SubapParams,
    TomoParams,
    TrackParams,
    Plane,
)
from ..session import cut_lineage


def focus(
    collect: Collect, grid: Grid, start: int = 0, count: int | None = None, range_taps: int = 0
) -> tuple[DataFrame, ImageMeta]:
    """One image from a run of pulses."""
    windows = full_aperture(collect.meta, start, count)
    meta, _ = image_meta(collect, grid, windows)
    return backproject(collect, grid, windows, range_taps), meta


def sampling_warning(collect: Collect, grid: Grid, resolution: float) -> str | None:
    """Cells far from the aperture's resolution waste pulses or lose detail."""
    if resolution > 0 and grid.dx > 2.0 * resolution:
        return f"cells of {grid.dx:g} m are coarser than the {resolution:.2f} m this aperture resolves"
    return None


def unambiguous_extent(collect: Collect, image: ImageMeta) -> float:
    """Along-track width an image can have before a strided pulse rate folds it."""
    if image.v_platform <= 0:
        return 0.0
    return collect.meta.wavelength * image.r0 * collect.meta.prf / (2.0 * image.v_platform)


@dataclass(frozen=True)
class Motion:
    """Everything the motion command reports; the DataFrames are persisted."""

    stack: ImageStack
    meta: MotionMeta
    motion: DataFrame
    series: DataFrame
    spectra: DataFrame
    best: dict
    consensus: dict
    refused: bool
    warnings: list[str]
    velocity_p2p: float
    nulls: dict[str, dict] = field(default_factory=dict)


def observe(
    collect: Collect, grid: Grid, subap: SubapParams, params: TrackParams, route: str = "pulse",
    shuffle_seed: int = 0,
) -> tuple[ImageStack, DataFrame, MotionMeta]:
    """Looks and tracked motion.  The stack is kept: several stages read it."""
    stack = build(collect, grid, subap, route)
    if stack.paired is not None:
        stack = paired_stack(stack.paired.persist(), stack.meta)
    else:
        stack = replace(stack, pixels=stack.pixels.persist())
    if shuffle_seed:
        stack = nulls.shuffle_once(stack, shuffle_seed)
    motion, meta = track(stack, params)
    return stack, motion.persist(), meta


def mmotion(
    collect: Collect, grid: Grid, subap: SubapParams, params: TrackParams, route: str | None = None,
    f_min: float = 0.0, detrend: str = "linear", null_trials: int = 0,
    shuffle_seed: int = 0,
) -> Motion:
    """Vibration frequency of a scene, its agreement and its nulls.

    Raises when no window resolves motion.  ``refused`` is set when too few windows
    agree for a frequency to be reported.
    """
    pair = params.reference == "pair"
    route = route or ("paper" if pair else "pulse")
    subap = replace(subap, pair=True) if pair else subap
    stack, motion, meta = observe(collect, grid, subap, params, route, shuffle_seed)
    source = "displacement" if params.estimator == "phase" else "velocity"
    series = pack_series(motion, meta.n_looks).persist()
    spectra = spectrum(series, meta, source, f_min, detrend).persist()
    best_frame = selection.best_window(spectra, meta)
    best = selection.require_window(best_frame, meta)
    agreed = selection.consensus(spectra, meta).withColumn(
        "refused", selection.consensus_refused("n_agree", "n_voting")
    )
    consensus = agreed.first().asDict()
    refused = consensus.pop("refused")
    marked = selection.agreeing(spectra, meta).where("agrees")
    block = selection.largest_block(marked)
    consensus |= block.first().asDict()
    cautions = best_frame.crossJoin(F.broadcast(block)).select(
        selection.warnings(meta).alias("w")
    ).first()["w"]
    swing = series.where(F.col("win") == best["win"]).select(
        (F.array_max("vel_los") - F.array_min("vel_los")).alias("p")
    ).first()["p"]
    found: dict[str, dict] = {}
    if null_trials:
        run = nulls.shuffle_null(stack, params, null_trials, best["prominence"], f_min, source, detrend)
        found["shuffle"] = run.first().asDict()
    return Motion(stack, meta, motion, series, spectra, best, consensus, refused, cautions, swing, found)


def change(stack: ImageStack, params: CcdParams) -> tuple[DataFrame, dict]:
    """Change map of a stack and the range of its statistic."""
    image = stack.meta.image
    found = ccd.change_map(stack.pixels, image.n_az, image.n_rg, params, stack.meta.n_looks).persist()
    return found, ccd.map_range(found).first().asDict()


def collect_shape(collect: Collect) -> DataFrame:
    """Slant range, chord and look angle of a collect, from its first, middle and last pulse; one row.

    The angle is NULL where the middle pulse is not above the scene.
    """
    n = collect.meta.n_pulse
    at = lambda p, c: F.max(F.when(F.col("pulse") == p, F.col(c)))
    ends = collect.geometry.where(F.col("pulse").isin(0, n // 2, n - 1)).agg(
        *[at(0, c).alias(f"f{c}") for c in ("px", "py", "pz")], *[at(n - 1, c).alias(f"l{c}") for c in ("px", "py", "pz")],
        *[at(n // 2, c).alias(f"m{c}") for c in ("px", "py", "pz", "r_ref")],
    )
    apart = F.sqrt(sum((F.pow(F.col(f"l{c}") - F.col(f"f{c}"), 2) for c in ("px", "py", "pz")), F.lit(0.0)))
    away = F.sqrt(sum((F.pow(F.col(f"m{c}"), 2) for c in ("px", "py", "pz")), F.lit(0.0)))
    slant = F.when(F.col("mr_ref") > 0, F.col("mr_ref")).otherwise(away)
    drop = F.abs("mpz")
    angle = F.when((drop > 0) & (drop <= slant), F.acos(drop / slant))
    return ends.select(slant.alias("slant_range"), apart.alias("aperture"), angle.alias("incidence"))


def collect_geometry(collect: Collect, params: TomoParams) -> TomoParams:
    """Slant range, aperture and incidence as the collect implies them."""
    found = collect_shape(collect).first()
    return replace(
        params, slant_range=found["slant_range"], aperture=found["aperture"],
        incidence=params.incidence if found["incidence"] is None else found["incidence"],
        radar_wavelength=collect.meta.wavelength,
    )


def patent_chain(params: TomoParams) -> TomoParams:
    """Force the unconditioned chain; a conflicting choice is refused, not overridden."""
    if params.model != "A":
        raise ArgumentError("the patent chain is model A only")
    if params.y_source != "shifts":
        raise ArgumentError("the patent chain uses the complex shift vector")
    return replace(
        params, solver="lstsq", convention="patent", window=False, remove_y_mean=False,
        regularisation=0.0, patent_exact=True, subap_window=False, coherence_min=0.0,
        pair_reference=True,
    )


@dataclass(frozen=True)
class Depth:
    params: TomoParams
    meta: MotionMeta
    grid: Grid
    tracking: TrackParams
    profiles: DataFrame
    spectra: DataFrame | None
    metadata: dict
    null: dict | None = None


def tomo(
    collect: Collect, grid: Grid, subap: SubapParams, tracking: TrackParams, params: TomoParams,
    route: str | None = None, detrend: str = "linear", align_trials: int = 0, align_seed: int = 1,
) -> Depth:
    """Depth profiles of a scene under stated assumptions."""
    if params.patent_exact:
        params = patent_chain(params)
        subap = replace(subap, window=False, pair=True)
        tracking = replace(tracking, reference="pair", coherence_min=0.0)
        route = route or "paper"
        if route != "paper":
            raise ArgumentError("the patent chain needs the paper layout")
    if tracking.estimator == "phase" and params.y_source == "shifts" and params.model in ("A", "C"):
        raise ArgumentError("the phase estimator measures no shifts; use the line-of-sight vector")
    if params.model == "C":
        raise ArgumentError("model C needs baselines of a multi-pass stack, which one collect lacks")
    if tracking.reference == "pair":
        subap = replace(subap, pair=True)
        route = route or "paper"
    route = route or "pulse"
    tomography.check_params(params)
    params = replace(
        params, subap_window=subap.window, coherence_min=tracking.coherence_min,
        pair_reference=tracking.reference == "pair",
        provenance=(
            f"subap={route} estimator={tracking.estimator} looks={subap.n_looks} "
            f"overlap={subap.overlap:.3f} win={tracking.win_az}x{tracking.win_rg} "
            f"coherence={tracking.coherence_min:.2f} offset={grid.origin[0]:.0f},{grid.origin[1]:.0f} "
            f"cell={grid.dx:.2f} detrend={'none' if params.patent_exact else detrend} "
            f"ref={tracking.reference}"
        ),
    )
    _, motion, meta = observe(collect, grid, subap, tracking, route)
    series = pack_series(motion, meta.n_looks).persist()
    spectra = None if params.patent_exact else spectrum(series, meta, detrend=detrend).persist()
    profiles = tomography.profiles(params, meta, series=series, spectra=spectra).persist()
    null = None
    if align_trials:
        depth = len(tomography.depth_axis(params))
        null = tomography.alignment_null(profiles, depth, align_trials, align_seed).first().asDict()
    return Depth(
        params, meta, grid, tracking, profiles, spectra,
        tomography.metadata(params, meta, tracking.exhaustive), null,
    )


def depth_windows(depth: Depth) -> DataFrame:
    """Peak depth per window beside the evidence its spectrum gives."""
    peaks = tomography.window_peaks(depth.profiles, depth.params)
    if depth.spectra is None:
        empty = [F.lit(0.0).alias("prominence"), F.lit(0.0).alias("dominant_hz")]
        return peaks.select(F.col("win").alias("window"), "quality", *empty, F.col("peak_depth").alias("peak_depth_m"), "peak_value")
    evidence = depth.spectra.select("win", "prominence", F.col("dominant_freq").alias("dominant_hz"))
    return peaks.join(evidence, "win").select(
        F.col("win").alias("window"), "quality", "prominence", "dominant_hz",
        F.col("peak_depth").alias("peak_depth_m"), "peak_value",
    )


def geocoded_windows(depth: Depth, collect: Collect) -> DataFrame:
    """Window centres on the ellipsoid with their peak depths; empty windows drop out."""
    peaks = tomography.window_peaks(depth.profiles, depth.params)
    return placed_windows(peaks, depth.grid, depth.tracking, collect.meta.plane)


def placed_windows(peaks: DataFrame, grid: Grid, t: TrackParams, plane: Plane) -> DataFrame:
    """Peaks of windows ``(win, iaz, irg, peak_depth, peak_value)`` at their centres on the ellipsoid."""
    peaks = peaks.where(F.col("peak_value") > 0)

    def centre(index: str, stride: int, win: int, n: int, step: float, origin: float):
        return origin + (F.col(index) * stride + win // 2 - 0.5 * (n - 1)) * step

    x = centre("iaz", t.stride_az or t.win_az, t.win_az, grid.n_x, grid.dx, grid.origin[0])
    y = centre("irg", t.stride_rg or t.win_rg, t.win_rg, grid.n_y, grid.dy, grid.origin[1])
    placed = peaks.withColumn("_g", geodesy.plane_llh(plane, x, y))
    return placed.select(
        F.col("win").alias("window"), F.col("_g.lat").alias("lat_deg"), F.col("_g.lon").alias("lon_deg"),
        F.col("_g.hae").alias("plane_hae_m"), F.col("peak_depth").alias("peak_depth_m"),
        (F.col("_g.hae") - F.col("peak_depth")).alias("peak_hae_m"), "peak_value",
    )


def resolve_at(spark: SparkSession, collect: Collect, lat: float, lon: float) -> tuple[float, float, float]:
    """Grid origin of a geodetic point on the collect's plane."""
    plane = collect.meta.plane
    offset = geodesy.plane_offset(plane, lat, lon, 0.0 if plane is None else plane.ref_hae)
    row = spark.range(1).select(offset.alias("o")).first()["o"]
    if row is None or row["x"] is None:
        raise RangeFault(f"latitude {lat:g} is outside [-90, 90]")
    return row["x"], row["y"], 0.0


@dataclass(frozen=True)
class Sweep:
    rows: DataFrame
    merged: DataFrame
    summary: dict
    per_realisation: list[dict]
    reliable: dict | None
    velocity: dict | None


def at_offsets(collect: Collect, offsets: Sequence[tuple[float, float]]) -> Collect:
    """The collect seen from each grid offset, ``offset`` among its columns.

    A grid moved one way is the platform moved the other, so all offsets share one grid and one pass.
    """
    moves = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("offset"), F.lit(float(x)).alias("_x"), F.lit(float(y)).alias("_y"))
        for i, (x, y) in enumerate(offsets)
    ])
    moved = collect.pulses.select("*", F.inline(moves))
    shifted = moved.withColumns({"px": F.col("px") - F.col("_x"), "py": F.col("py") - F.col("_y")}).drop("_x", "_y")
    return Collect(shifted, collect.meta)


def _offset_motion(
    collect: Collect, grid: Grid, offsets: Sequence[tuple[float, float]], subap: SubapParams, tracking: TrackParams, route: str
) -> tuple[DataFrame, MotionMeta]:
    """Motion of every offset, ``offset`` being a key: pulse windows in one plan, spectral splits image by image."""
    centred = replace(grid, origin=(0.0, 0.0, 0.0))
    if route == "pulse":
        stack = build(collect, centred, subap, route)
        windows = pulse_windows(collect.meta.n_pulse, subap.n_looks, subap.overlap)
        pixels = backproject(at_offsets(collect, offsets), centred, windows, subap.range_taps, ["offset"])
        return track(replace(stack, pixels=pixels), tracking, ["offset"])
    parts = []
    for offset, (x, y) in enumerate(offsets):
        stack = build(collect, replace(grid, origin=(x, y, 0.0)), subap, route)
        motion, meta = track(stack, tracking)
        parts.append(motion.withColumn("offset", F.lit(offset).cast("bigint")))
    return _together(parts), meta


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def sweep_rows(
    collects: Sequence[Collect], params: TomoParams, subap: SubapParams, tracking: TrackParams,
    grid: Grid, offsets: Sequence[tuple[float, float]] = ((0.0, 0.0),), scale_min: float = 0.5,
    scale_max: float = 2.0, n_scale: int = 5, f_min: float = 0.0, route: str = "pulse",
    refuse_outside: bool = True,
) -> DataFrame:
    """Where the peak lands for every scene, offset and assumption, as one plan: scene and offset are columns.

    A long collect has slow looks, whose spectra may represent none of the depths.  Such assumptions are refused;
    without ``refuse_outside`` each keeps its row, with the peak value 0.
    """
    parts = []
    for scene, collect in enumerate(collects):
        scaled = collect_geometry(collect, params)
        tomography.check_params(scaled)
        motion, meta = _offset_motion(collect, grid, offsets, subap, tracking, route)
        series = pack_series(motion, meta.n_looks, ["offset"])
        spectra = spectrum(series, meta, f_min=f_min, keys=["offset"])
        rows = tomography.sweep(
            scaled, meta, series=series, spectra=spectra, scale_min=scale_min,
            scale_max=scale_max, n_scale=n_scale, keys=["offset"], refuse_outside=refuse_outside,
        )
        parts.append(rows.withColumn("scene", F.lit(scene)))
    return _together(parts)


def sweep(
    collects: Sequence[Collect], params: TomoParams, subap: SubapParams, tracking: TrackParams,
    grid: Grid, offsets: Sequence[tuple[float, float]] = ((0.0, 0.0),), scale_min: float = 0.5,
    scale_max: float = 2.0, n_scale: int = 5, f_min: float = 0.0, route: str = "pulse",
) -> Sweep:
    """Does the depth follow the assumptions?  Every scene and offset is a realisation.

    All realisations are formed, tracked and swept in one job; the assumption grid costs no further
    pass, whatever its size.
    """
    # Scenes x offsets x scales^2 rows, which four fits read.
    rows = cut_lineage(sweep_rows(
        collects, params, subap, tracking, grid, offsets, scale_min, scale_max, n_scale, f_min, route))
    merged = tomography.sweep_merge(rows)
    fits = tomography.sweep_summary(rows, ["scene", "offset"])
    several = len(collects) * len(offsets) > 1
    return Sweep(
        rows, merged, tomography.sweep_summary(merged).first().asDict(),
        [r.asDict() for r in fits.orderBy("scene", "offset").collect()],
        tomography.sweep_summary_reliable(merged).first().asDict() if several else None,
        tomography.velocity_fit(rows).first().asDict() if params.model == "D" else None,
    )


def sweep_verdict(found: Sweep) -> str:
    """What the fits say about the depth axis, in one word."""
    fit = found.reliable
    if fit is None:
        return "single_realisation"
    slope, corr = fit["slope"], fit["correlation"]
    if slope is None:
        return "too_few_wavelengths"
    if corr > 0.95 and 0.85 < slope < 1.15:
        return "follows_assumption"
    if abs(slope) < 0.2 and abs(corr) > 0.8:
        return "pinned_by_data"
    return "ambiguous"


def validate(requests: DataFrame) -> tuple[list[dict], str]:
    """Findings and verdict of one request row."""
    found = validation.findings(requests).persist()
    rows = [r.asDict() for r in found.orderBy("ord").collect()]
    return rows, validation.verdict(found).first()["verdict"]


def collect_facts(collect: Collect) -> DataFrame:
    """What a collect's pulses say, in one pass over their geometry."""
    count, span = F.count(F.lit(1)), F.max("t") - F.min("t")
    return collect.geometry.agg(
        count.alias("n_pulses"), F.lit(collect.meta.n_rbin).cast("bigint").alias("n_bins"), span.alias("dwell"),
        F.try_divide(count - 1, span).alias("prf"), F.min("r_ref").alias("near_ref"), F.max("r_ref").alias("far_ref"),
    )


def info(collect: Collect) -> dict:
    """A phase history's own account of itself."""
    meta = collect.meta
    span = collect_facts(collect).first()["dwell"]
    return {
        "source": meta.source, "pulses": meta.n_pulse, "range_bins": meta.n_rbin,
        "carrier_ghz": meta.fc / 1e9, "wavelength_m": meta.wavelength, "transmit_prf_hz": meta.prf,
        "dwell_s": span, "near_range_m": meta.r_near, "range_bin_m": meta.dr,
    }


def scene_places(spark: SparkSession, meta: ImageMeta) -> DataFrame:
    """Corners and centre of a focused image on the ellipsoid: ``(place, lat, lon, hae)``.

    A pixel of a slant plane is moved round its range-Doppler circle to the plane's reference height.  Without a plane
    there are no rows.
    """
    plane = meta.plane
    if plane is None:
        return spark.createDataFrame([], "place string, lat double, lon double, hae double")
    vector = lambda v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("xyz", v)])
    scene = spark.range(1).select(
        F.lit(meta.n_az).alias("n_az"), F.lit(meta.n_rg).alias("n_rg"), F.lit(float(meta.az_spacing)).alias("az_spacing"),
        F.lit(float(meta.rg_spacing)).alias("rg_spacing"), vector(plane.origin).alias("origin"), vector(plane.u_x).alias("u_x"),
        vector(plane.u_y).alias("u_y"), vector(plane.sensor).alias("sensor"), vector(plane.sensor_vel).alias("sensor_vel"),
        F.lit(float(plane.ref_hae)).alias("ref_hae"),
    )
    return places_of_scenes(scene, (), plane.is_slant)


def places_of_scenes(scenes: DataFrame, keys: Sequence[str], slant: bool = False) -> DataFrame:
    """The same for many scenes, five rows each: ``(*keys, place, lat, lon, hae)``.

    A scene is ``n_az, n_rg, az_spacing, rg_spacing`` and the vectors ``origin, u_x, u_y``; a slant one has ``sensor,
    sensor_vel, ref_hae`` as well.
    """
    az, rg = F.col("n_az") - 1.0, F.col("n_rg") - 1.0
    zero = F.lit(0.0)
    spots = (("first", zero, zero), ("last_range", zero, rg), ("last", az, rg), ("last_azimuth", az, zero), ("centre", az / 2, rg / 2))
    spread = scenes.select("*", F.inline(F.array(*[
        F.struct(F.lit(name).alias("place"), a.alias("_a"), r.alias("_r")) for name, a, r in spots])))
    point = F.struct(*[
        (F.col(f"origin.{n}") + F.col("_a") * F.col("az_spacing") * F.col(f"u_x.{n}")
         + F.col("_r") * F.col("rg_spacing") * F.col(f"u_y.{n}")).alias(n)
        for n in "xyz"
    ])
    if slant:
        point = geodesy.slant_to_ground(F.col("sensor"), F.col("sensor_vel"), point, F.col("ref_hae"))
    ground = spread.select(*keys, "place", point.alias("p"))
    llh = ground.select(*keys, "place", geodesy.ecf_to_llh("p.x", "p.y", "p.z").alias("g"))
    return llh.select(*keys, "place", "g.lat", "g.lon", "g.hae")


def image_info(pixels: DataFrame, meta: ImageMeta) -> dict:
    """A focused product's geometry, with Doppler figures measured from its pixels."""
    columns = pack_columns(pixels)
    power = azimuth_power_spectrum(columns).persist()
    doppler = doppler_centroid(power, meta.n_az, meta.fs_az).crossJoin(
        doppler_bandwidth(power, meta.n_az, meta.fs_az)
    ).first()
    return {
        "source": meta.source, "azimuth": meta.n_az, "range": meta.n_rg,
        "carrier_ghz": meta.fc / 1e9, "wavelength_m": meta.wavelength,
        "azimuth_line_rate_hz": meta.fs_az, "transmit_prf_hz": meta.pulse_prf,
        "azimuth_spacing_m": meta.az_spacing, "range_spacing_m": meta.rg_spacing,
        "platform_ms": meta.v_platform, "dwell_s": meta.t_dwell,
        "doppler_centroid_hz": doppler["centroid_hz"], "doppler_bandwidth_hz": doppler["bandwidth_hz"],
        "places": {r["place"]: (r["lat"], r["lon"], r["hae"]) for r in scene_places(pixels.sparkSession, meta).collect()},
    }
