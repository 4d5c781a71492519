"""Every operator as a query over the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import geodesy as geo
from ..functions import geometry as g
from ..functions import transforms
from ..operators import (
    ccd,
    focus,
    nulls,
    patches,
    raster,
    reports,
    selection,
    tomography,
    tracking,
    validation,
)
from ..operators.orbit import interpolate_orbit, interpolate_orbit_asof
from ..operators.spectrum import (
    lowest_bin,
    pack_series,
    spectrum,
    spectrum_bins,
    unpack_series,
)
from ..operators.subaperture import (
    ImageStack,
    azimuth_power_spectrum,
    doppler_bandwidth,
    doppler_centroid,
    pulse_windows,
    split,
)
from ..params import CcdParams, Grid, ImageMeta, Plane, SubapParams, TomoParams, TrackParams
from . import commands
from . import tables as t
from .feasibility import feasibility

Query = Callable[[SparkSession, str], DataFrame]

PLANE = Plane(
    origin=(-120301.196, -4594117.3286, 4408300.01),
    u_x=(0.9996573, -0.0261769, 0.0), u_y=(0.018184, 0.6944203, 0.7193398), ref_hae=300.0,
)
TRACK = TrackParams(
    win_az=4, win_rg=4, stride_az=2, stride_rg=2, upsample_az=4, upsample_rg=4,
    coherence_min=0.62, looks_per_task=64, block_windows=4,
)
TOMO = TomoParams(
    velocity=3000.0, frequency=12500.0, depth_max=12.0, depth_cell=0.5,
    slant_range=500000.0, aperture=75000.0,
)
RESONANCE = replace(TOMO, model="D", velocity=100.0, frequency=50.0, depth_max=60.0, depth_cell=5.0)
STANDING = replace(TOMO, model="B", velocity=100.0, frequency=10.0, depth_max=60.0, depth_cell=20.0)
BASELINES = tuple(1000.0 * i / (t.EVENT_LOOKS - 1) for i in range(t.EVENT_LOOKS))
MULTIPASS = replace(TOMO, model="C", aperture=1000.0, depth_max=40.0, depth_cell=10.0)
SPLIT = SubapParams(n_looks=4, overlap=0.4)
IMAGE = ImageMeta(
    n_az=t.COLUMN_LINES, n_rg=0, fs_az=t.COLUMN_RATE, azimuth_time_interval=1 / t.COLUMN_RATE,
    wavelength=0.031, r0=600000.0, t_dwell=1.0, v_platform=7500.0, az_spacing=1.0,
)
CHANGE = CcdParams(win=3, tile=8, looks_per_task=16)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded to 6 digits (or as given), halves up; integers widened.

    Rounding is arithmetic, so it stays in generated code.
    """
    out = []
    for field in df.schema.fields:
        kind, c = field.dataType.simpleString(), F.col(field.name)
        if kind in ("double", "float"):
            unit = 10.0 ** digits.get(field.name, 6)
            c = F.floor(F.nanvl(c.cast("double"), F.lit(None)) * unit + 0.5) / F.lit(unit)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


# -- geometry ---------------------------------------------------------------------


def q_acoustic_wavelength(spark: SparkSession, d: str) -> DataFrame:
    rows = t.geometry_rows(spark, d)
    return rounded(rows.select(
        "l_orderkey", "l_linenumber",
        g.acoustic_wavelength("v", "f", "paper").alias("paper"),
        g.acoustic_wavelength("v", "f", "patent").alias("patent"),
    ))


def q_resolution_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = t.geometry_rows(spark, d)
    lam = g.acoustic_wavelength("v", "f")
    aperture = g.orbital_aperture("v", "dwell")
    return rounded(rows.select(
        "l_orderkey", "l_linenumber",
        aperture.alias("aperture"),
        g.depth_resolution(lam, "slant", aperture).alias("depth_res"),
        g.azimuth_resolution(0.031, "slant", "v", "dwell").alias("az_res"),
        g.vibration_fmax("l_linenumber", "dwell").alias("fmax"),
        g.vibration_fmax_overlap("dwell", "overlap").alias("fmax_overlap"),
        g.observation_ratio("dwell", "f").alias("obs_ratio"),
        g.spectrum_observation_ratio("dwell", "f").alias("eta"),
        g.subaperture_response("theta", "f").alias("response"),
        g.max_velocity(64, "overlap", "slant", "v").alias("v_max"),
        g.recommend_looks("f", 0.002, "dwell", 0.031, "overlap").alias("looks"),
    ), depth_res=3, aperture=3)


def q_tomographic_wavenumber(spark: SparkSession, d: str) -> DataFrame:
    rows = t.geometry_rows(spark, d)
    kz = g.wavenumber(75000.0, g.acoustic_wavelength("v", "f"), "slant", "theta")
    top = pandas_udf(lambda kz: pd.Series(tomography.repeat_depth(kz, 64)), "double")
    keyed = rows.select("l_orderkey", "l_linenumber", kz.alias("kz"))
    return rounded(keyed.withColumn("max_depth", top("kz")), kz=5, max_depth=4)


def q_depth_scales(spark: SparkSession, d: str) -> DataFrame:
    """Literal times in the depth phase and the resolution they leave."""
    rows = t.geometry_rows(spark, d).withColumn("when", F.col("overlap") - 0.3)
    scale = pandas_udf(lambda when: pd.Series(tomography.time_scale(when)), "double")
    scaled = rows.withColumn("scale", scale("when"))
    cell = g.depth_resolution(g.acoustic_wavelength("v", "f"), "slant", 75000.0) / F.col("scale")
    return rounded(scaled.select("l_orderkey", "l_linenumber", "scale", cell.alias("resolution")))


def q_conditioning(spark: SparkSession, d: str) -> DataFrame:
    """How well each geometry's sixteen looks resolve three depths."""
    rows = t.geometry_rows(spark, d)
    kz = g.wavenumber(75000.0, g.acoustic_wavelength("v", "f"), "slant", "theta")
    asked = rows.select("l_orderkey", "l_linenumber", kz.alias("kz"), F.lit(2.0).alias("cell"))
    found = tomography.conditioning_rows(asked, "kz", "cell", 16, 3)
    return rounded(found.select("l_orderkey", "l_linenumber", "rank", "sv_max", "sv_min"), sv_max=4, sv_min=4)


def q_feasibility(spark: SparkSession, d: str) -> DataFrame:
    orders = t.table(spark, d, "orders").select(
        "o_orderkey",
        (1.0 + F.sqrt("o_totalprice") / 40.0).alias("dwell"),
        F.lit(640000.0).alias("slant"), F.lit(7410.0).alias("speed"),
        F.lit(0.0305).alias("wavelength"),
    )
    return rounded(feasibility(orders, ["o_orderkey"]))


def q_band_shape(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem")
    return rounded(rows.select(
        "l_orderkey", "l_linenumber",
        g.raised_cosine(F.col("l_quantity") - 25.0, 0.0, 30.0, 7.5).alias("gain"),
        g.bin_frequency("l_quantity", 51, 100.0).alias("freq"),
        g.wrap_phase(F.col("l_extendedprice") / 1000.0).alias("wrapped"),
    ))


def q_doppler_polynomial(spark: SparkSession, d: str) -> DataFrame:
    vectors = t.table(spark, d, "embeddings")
    # Every vector is eight polynomials of eight coefficients.
    blocks = vectors.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block"))
    coeff = F.transform(F.slice("embedding", F.col("block") * 8 + 1, 8), lambda x: x.cast("double"))
    return rounded(blocks.select(
        "vec_id", "block", g.doppler_polynomial(coeff, F.col("label") / 5.0, 1.5).alias("doppler_hz")
    ))


def q_orbit_interp(spark: SparkSession, d: str) -> DataFrame:
    vectors = t.table(spark, d, "embeddings")
    at = lambda i, k: F.element_at("embedding", i * 8 + k).cast("double")
    states = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.struct(
            # The two floats left over shift the state's time.
            (i + 0.05 * F.tanh(at(i, 7)) + 0.05 * F.tanh(at(i, 8))).alias("t"),
            F.array(*[at(i, k) for k in (1, 2, 3)]).alias("pos"),
            F.array(*[at(i, k) for k in (4, 5, 6)]).alias("vel"),
        ),
    )
    rows = vectors.select(
        "vec_id", states.alias("states"), (F.col("label") * 0.93 - 0.4).alias("when")
    )
    state = interpolate_orbit(rows, "states", "when", "s")
    return rounded(state.select(
        "vec_id", F.col("s.t").alias("t"),
        *[F.col("s.pos")[k].alias(f"p{k}") for k in range(3)],
        *[F.col("s.vel")[k].alias(f"v{k}") for k in range(3)],
    ))


def q_orbit_asof(spark: SparkSession, d: str) -> DataFrame:
    """Where three platforms are at the events' moments, from the orders as their state vectors."""
    price, customer = F.col("o_totalprice") / 100000.0, F.col("o_custkey") / 100.0
    states = t.table(spark, d, "orders").select(
        (F.col("o_custkey") % 3).alias("platform"), (F.col("o_orderkey") * 173.0).alias("t"),
        F.array(price, customer, price * customer).alias("pos"), F.array(customer, price, price - customer).alias("vel"),
    )
    events = t.table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 3).alias("platform"), ((t.micros("ts") - 1704067200000000) / 1000000.0).alias("when"))
    found = interpolate_orbit_asof(events, states, "when", ["platform"], "s")
    digits = {f"{c}{k}": 4 for c in "pv" for k in range(3)}
    return rounded(found.select(
        "event_id", "platform", F.col("s.t").alias("t"),
        *[F.col("s.pos")[k].alias(f"p{k}") for k in range(3)], *[F.col("s.vel")[k].alias(f"v{k}") for k in range(3)],
    ), t=3, **digits)


def q_scene_places(spark: SparkSession, d: str) -> DataFrame:
    """Corners and centre of an image whose first pixel lies at each place."""
    at = geo.llh_to_ecf("lat", "lon", "hae")
    axis = lambda u: F.struct(*[F.lit(x).alias(n) for n, x in zip("xyz", u)])
    scenes = _places(spark, d).select(
        "key", F.struct(*[at[n].alias(n) for n in "xyz"]).alias("origin"), axis(PLANE.u_x).alias("u_x"), axis(PLANE.u_y).alias("u_y"),
        F.lit(2001).alias("n_az"), F.lit(1001).alias("n_rg"), F.lit(0.5).alias("az_spacing"), F.lit(0.75).alias("rg_spacing"),
    )
    return rounded(commands.places_of_scenes(scenes, ["key"]), hae=3)


def q_image_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem")
    fault = g.image_faults(
        F.col("l_extendedprice") * 1.02, F.col("l_discount") * 12.0,
        F.col("l_quantity") - 2.0, F.lit(1.5), F.col("l_tax") * 20.0,
        F.col("l_extendedprice") * 20.0,
    )
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(fault, F.lit("ok")).alias("fault"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return t.table(spark, d, "customer").select(
        key.alias("key"),
        ((key * 37) % 179 - 89).cast("double").alias("lat"),
        ((key * 73) % 359 - 179).cast("double").alias("lon"),
        F.col("c_acctbal").alias("hae"),
    )


def q_ecf_llh_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    placed = _places(spark, d).select("key", geo.llh_to_ecf("lat", "lon", "hae").alias("e"))
    back = placed.select(
        "key", "e.x", "e.y", "e.z", geo.ecf_to_llh("e.x", "e.y", "e.z").alias("g")
    )
    return rounded(
        back.select("key", "x", "y", "z", "g.lat", "g.lon", "g.hae"), x=3, y=3, z=3, hae=3
    )


def q_plane_offset(spark: SparkSession, d: str) -> DataFrame:
    near = _places(spark, d).select(
        "key", (44.0 + F.col("lat") / 100.0).alias("lat"),
        (-91.5 + F.col("lon") / 100.0).alias("lon"), "hae",
    )
    offset = near.select("key", geo.plane_offset(PLANE, "lat", "lon", "hae").alias("o"))
    located = offset.select("key", "o.x", "o.y", geo.plane_llh(PLANE, "o.x", "o.y").alias("g"))
    return rounded(
        located.select("key", "x", "y", "g.lat", "g.lon", "g.hae"), x=3, y=3, hae=3
    )


def _look_rays(spark: SparkSession, d: str) -> DataFrame:
    """A sensor 600 km up and a point below it, per customer."""
    # A row costs far more to project than to read, so a file's rows are dealt to all tasks.
    p = _places(spark, d).repartition(spark.sparkContext.defaultParallelism)
    ground = geo.llh_to_ecf("lat", "lon", F.lit(0.0))
    sensor = geo.llh_to_ecf(F.col("lat") * 0.97, F.col("lon") * 0.97, F.lit(600000.0))
    return p.select(
        "key", ground.alias("point"), sensor.alias("sensor"),
        (F.col("hae") / 10.0).alias("target"),
    )


def q_project_to_height(spark: SparkSession, d: str) -> DataFrame:
    rays = _look_rays(spark, d)
    hit = rays.select("key", geo.project_to_height("sensor", "point", "target").alias("p"))
    return rounded(hit.select("key", "p.x", "p.y", "p.z"), x=2, y=2, z=2)


def q_slant_to_ground(spark: SparkSession, d: str) -> DataFrame:
    rays = _look_rays(spark, d)
    velocity = F.struct(
        F.lit(3000.0).alias("x"), F.lit(-2000.0).alias("y"), F.lit(6500.0).alias("z")
    )
    hit = rays.select(
        "key", geo.slant_to_ground("sensor", velocity, "point", "target").alias("p")
    )
    return rounded(hit.select("key", "p.x", "p.y", "p.z"), x=2, y=2, z=2)


# -- Doppler and sub-apertures ------------------------------------------------------


def _label_power(spark: SparkSession, d: str) -> DataFrame:
    return azimuth_power_spectrum(t.image_columns(spark, d), "label")


def q_azimuth_power(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_label_power(spark, d))


def q_doppler_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(doppler_centroid(_label_power(spark, d), t.COLUMN_LINES, t.COLUMN_RATE, "label"))


def q_doppler_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(doppler_bandwidth(_label_power(spark, d), t.COLUMN_LINES, t.COLUMN_RATE, "label"))


def q_spectral_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(split(t.image_pixels(spark, d), IMAGE, SPLIT).pixels)


def q_paired_split(spark: SparkSession, d: str) -> DataFrame:
    paired = SubapParams(mode="paper", n_looks=4, pair=True, window=False)
    stack = split(t.image_pixels(spark, d), IMAGE, paired)
    role = F.when(F.col("slave"), "slave").otherwise("master")
    return rounded(stack.paired.withColumn("role", role).drop("slave"))


def q_sliding_subapertures(spark: SparkSession, d: str) -> DataFrame:
    events = t.table(spark, d, "events").select(F.col("event_id").alias("pulse"), "value")
    windows = pulse_windows(events.count(), 16, 0.4)

    def within(batches):
        for batch in batches:
            pulse, value = batch.column("pulse").to_numpy(), batch.column("value").to_numpy()
            member = windows.members(pulse)
            look = np.flatnonzero(member.any(axis=1))
            own = member[look]
            yield pa.RecordBatch.from_arrays(
                [pa.array(look), pa.array(own.sum(axis=1)), pa.array(np.where(own, pulse, np.iinfo(np.int64).max).min(axis=1)),
                 pa.array(np.where(own, pulse, -1).max(axis=1)), pa.array(own @ value)],
                names=["look", "n", "first", "last", "total"],
            )

    parts = events.mapInArrow(within, "look bigint, n bigint, first bigint, last bigint, total double")
    return rounded(parts.groupBy("look").agg(
        F.sum("n").alias("n_pulses"), F.min("first").alias("first_pulse"),
        F.max("last").alias("last_pulse"), (F.sum("total") / F.sum("n")).alias("mean_value"),
    ))


def _aperture(spark: SparkSession, d: str):
    collect = t.pulse_table(spark, d)
    return collect, pulse_windows(collect.meta.n_pulse, 4, 0.4)


def q_backproject(spark: SparkSession, d: str) -> DataFrame:
    collect, windows = _aperture(spark, d)
    return rounded(focus.backproject(collect, t.PULSE_GRID, windows))


def q_backproject_sinc(spark: SparkSession, d: str) -> DataFrame:
    collect, windows = _aperture(spark, d)
    return rounded(focus.backproject(collect, t.PULSE_GRID, windows, range_taps=8))


def q_window_geometry(spark: SparkSession, d: str) -> DataFrame:
    collect, windows = _aperture(spark, d)
    return rounded(focus.window_geometry(collect, t.PULSE_GRID, windows))


def q_azimuth_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(focus.azimuth_resolutions(t.pulse_table(spark, d)))


def q_collect_shape(spark: SparkSession, d: str) -> DataFrame:
    return rounded(commands.collect_shape(t.pulse_table(spark, d)))


def _pulse_spectra(spark: SparkSession, d: str):
    collect = t.pulse_table(spark, d)
    windows = pulse_windows(collect.meta.n_pulse, t.FILM_LOOKS, 0.4)
    looks = ImageStack(focus.backproject(collect, Grid(n_x=t.FILM_AZ, n_y=t.FILM_RG), windows), t.FILM_META)
    motion, meta = tracking.track(looks, replace(TRACK, coherence_min=0.0))
    return spectrum(pack_series(motion, meta.n_looks), meta), meta


def q_pulses_to_depth(spark: SparkSession, d: str) -> DataFrame:
    """Pulses to looks, motion, spectra and a resonance depth profile."""
    spectra, meta = _pulse_spectra(spark, d)
    cells = tomography.profile_cells(tomography.profiles(RESONANCE, meta, spectra=spectra), RESONANCE)
    return rounded(cells.select("win", "j", "depth", "value"), value=8)


def q_pulses_to_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Pulses to looks, looks to motion, motion to spectra."""
    return rounded(_pulse_spectra(spark, d)[0].drop("psd"))


# -- tracking -----------------------------------------------------------------------


def _tracked(reference: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        stack = t.film_stack(spark, d)
        if reference == "pair":
            rolled = stack.pixels.withColumn("az", (F.col("az") + 1) % t.FILM_AZ)
            stack = replace(stack, slave=rolled)
        params = replace(TRACK, reference=reference, ref_lag=3)
        motion, _ = tracking.track(stack, params, ["film"])
        return rounded(motion)

    return run


def q_phase_track(spark: SparkSession, d: str) -> DataFrame:
    params = replace(TRACK, estimator="phase", coherence_min=0.45)
    motion, _ = tracking.track(t.film_stack(spark, d), params, ["film"])
    return rounded(motion)


def q_splitband_track(spark: SparkSession, d: str) -> DataFrame:
    params = replace(TRACK, estimator="splitband", win_az=8, win_rg=4, coherence_min=0.0)
    motion, _ = tracking.track(t.film_stack(spark, d), params, ["film"])
    return rounded(motion)


def q_exhaustive_track(spark: SparkSession, d: str) -> DataFrame:
    params = replace(TRACK, exhaustive=True)
    motion, _ = tracking.track(t.film_stack(spark, d), params, ["film"])
    return rounded(motion)


def q_patch_demean(spark: SparkSession, d: str) -> DataFrame:
    """Energy left in each image once its complex mean is removed."""

    def demeaned(batches):
        for batch in batches:
            pairs = np.stack(batch["embedding"].to_numpy()).astype(float).reshape(len(batch), t.FILM_AZ, t.FILM_RG, 2)
            image = pairs[..., 0] + 1j * pairs[..., 1]
            left = patches.demean(image)
            mean = (image - left)[:, 0, 0]
            yield pd.DataFrame({
                "film": batch["vec_id"] // t.FILM_LOOKS, "look": batch["vec_id"] % t.FILM_LOOKS, "mre": mean.real, "mim": mean.imag,
                "residual": (np.abs(left) ** 2).mean(axis=(1, 2)),
            })

    vectors = t.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(vectors.mapInPandas(demeaned, "film bigint, look bigint, mre double, mim double, residual double"))


def _motion(spark: SparkSession, d: str) -> DataFrame:
    return unpack_series(t.event_series(spark, d))


def q_reference_series(spark: SparkSession, d: str) -> DataFrame:
    """Lagged, accumulated and differenced forms of each window's series."""
    along = Window.partitionBy("win").orderBy("look")
    return rounded(_motion(spark, d).select(
        "win", "look",
        F.coalesce(F.col("disp_az") - F.lag("disp_az", 4).over(along), F.lit(0.0)).alias("lagged"),
        tracking.accumulated("disp_az", along).alias("accumulated"),
        tracking.rate("disp_los", along, t.EVENT_META.dt).alias("rate"),
    ))


def q_common_mode_removed(spark: SparkSession, d: str) -> DataFrame:
    cleaned = tracking.remove_common_mode(_motion(spark, d), t.FILM_META)
    return rounded(cleaned.select("win", "look", "disp_az", "disp_rg", "vel_los"), vel_los=8)


# -- spectra and selection ------------------------------------------------------------


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    return spectrum(t.event_series(spark, d), t.EVENT_META)


def q_spectrum_psd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum_bins(_spectra(spark, d), t.EVENT_META))


def q_window_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_spectra(spark, d).drop("psd"))


def q_displacement_spectrum(spark: SparkSession, d: str) -> DataFrame:
    found = spectrum(
        t.event_series(spark, d), t.EVENT_META, "displacement", f_min=0.3, detrend="mean"
    )
    assert lowest_bin(t.EVENT_META, 0.3) == 5
    return rounded(found.drop("psd"))


def q_best_window(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.best_window(_spectra(spark, d), t.EVENT_META))


def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    found = selection.consensus(_spectra(spark, d), t.EVENT_META)
    return rounded(found.withColumn("refused", selection.consensus_refused("n_agree", "n_voting")))


def q_window_evidence(spark: SparkSession, d: str) -> DataFrame:
    shown = selection.agreeing(_spectra(spark, d), t.EVENT_META)
    return rounded(shown.select(
        "win", "iaz", "irg", "dominant_freq", "prominence", "quality", "excursion_px",
        "passed", "agrees",
    ))


def q_largest_block(spark: SparkSession, d: str) -> DataFrame:
    shown = selection.agreeing(_spectra(spark, d), t.EVENT_META)
    return selection.largest_block(shown.where("agrees"), tile=4)


def q_eligible_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the 4-connected blocks of windows passing the gates."""
    passed = selection.gate(_spectra(spark, d), t.EVENT_META).where("passed")
    labelled = selection.connected_blocks(passed, tile=4)
    sizes = labelled.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_blocks"))


def q_selection_report(spark: SparkSession, d: str) -> DataFrame:
    spectra = _spectra(spark, d)
    best = selection.best_window(spectra, t.EVENT_META)
    block = selection.largest_block(
        selection.agreeing(spectra, t.EVENT_META).where("agrees"), tile=4
    )
    joined = best.crossJoin(F.broadcast(block))
    cautions = F.array_join(selection.warnings(t.EVENT_META), ",")
    return rounded(joined.select("win", "dominant_freq", "prominence", cautions.alias("warnings")))


def q_shift_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.shift_statistics(t.event_series(spark, d), t.EVENT_META, 0.9))


def q_strongest_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.strongest_windows(_spectra(spark, d)))


def q_control_report(spark: SparkSession, d: str) -> DataFrame:
    found = reports.control_report(_spectra(spark, d), t.EVENT_META, 1.0, keys=["irg"])
    return rounded(found)


# -- depth ------------------------------------------------------------------------------


def _profile(spark: SparkSession, d: str, params: TomoParams) -> DataFrame:
    if params.model in ("B", "D"):
        return tomography.profiles(params, t.EVENT_META, spectra=_spectra(spark, d))
    baselines = BASELINES if params.model == "C" else None
    return tomography.profiles(
        params, t.EVENT_META, series=t.event_series(spark, d), baselines=baselines
    )


def _cells(params: TomoParams) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cells = tomography.profile_cells(_profile(spark, d, params), params)
        return rounded(cells.select("win", "j", "depth", "value"), value=4)

    return run


def q_window_peaks(spark: SparkSession, d: str) -> DataFrame:
    peaks = tomography.window_peaks(_profile(spark, d, TOMO), TOMO)
    return rounded(peaks.select("win", "quality", "peak_depth", "peak_value"), peak_value=4)


def q_profile_peak(spark: SparkSession, d: str) -> DataFrame:
    mean = tomography.mean_profile(_profile(spark, d, TOMO))
    return rounded(tomography.interpolated_peak(mean, TOMO.depth_cell), peak_value=4)


def q_stack_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tomography.stack_contrast(_profile(spark, d, TOMO)))


def q_alignment_null(spark: SparkSession, d: str) -> DataFrame:
    n_depth = len(tomography.depth_axis(TOMO))
    return rounded(tomography.alignment_null(_profile(spark, d, TOMO), n_depth, 16, seed=7))


def _sweep(spark: SparkSession, d: str, params: TomoParams) -> DataFrame:
    if params.model in ("B", "D"):
        return tomography.sweep(params, t.EVENT_META, spectra=_spectra(spark, d), n_scale=3)
    return tomography.sweep(params, t.EVENT_META, series=t.event_series(spark, d), n_scale=3)


SHIFTED = ((0.0, 0.0), (3.0, 0.0), (0.0, 2.0), (3.0, 2.0))
SWEPT = replace(TOMO, depth_max=8.0, depth_cell=1.0)


def q_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sweep(spark, d, SWEPT), peak_value=4)


def q_sweep_resonance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sweep(spark, d, RESONANCE), peak_value=4)


def q_sweep_realisations(spark: SparkSession, d: str) -> DataFrame:
    """Four offsets of one collect through focus, tracking, spectra and the assumption grid, as one plan."""
    rows = commands.sweep_rows(
        [t.pulse_table(spark, d)], replace(RESONANCE, frequency=400.0), SubapParams(n_looks=t.FILM_LOOKS, overlap=0.4),
        replace(TRACK, coherence_min=0.0), Grid(n_x=t.FILM_AZ, n_y=t.FILM_RG), SHIFTED, n_scale=3,
        refuse_outside=False)
    return rounded(rows.select("scene", "offset", "velocity", "frequency", "lambda_ac", "resolution", "peak_depth", "peak_value"), peak_value=8)


def _assumed(spark: SparkSession, d: str) -> DataFrame:
    """Line items as swept assumptions: wavelength by quantity, depth by price."""
    return t.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("scene"),
        (F.col("l_quantity") * 0.01).alias("lambda_ac"),
        (F.col("l_quantity") * (1.0 + F.col("l_tax")) * F.sqrt(F.col("l_extendedprice"))).alias("peak_depth"),
        F.col("l_discount").alias("peak_value"),
    )


def q_sweep_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tomography.sweep_merge(_assumed(spark, d), ["scene"]))


def q_sweep_fit(spark: SparkSession, d: str) -> DataFrame:
    merged = tomography.sweep_merge(_assumed(spark, d), ["scene"])
    whole = tomography.sweep_summary(merged, ["scene"])
    steady = tomography.sweep_summary_reliable(merged, 0.45, ["scene"]).select(
        "scene", F.col("n_used").alias("n_steady"), F.col("slope").alias("slope_steady"),
        F.col("correlation").alias("corr_steady"),
    )
    return rounded(whole.join(steady, "scene", "left"))


def q_depth_slice(spark: SparkSession, d: str) -> DataFrame:
    cut = tomography.nearest_slice(_profile(spark, d, TOMO), TOMO, 7.3)
    return rounded(cut.select("win", "depth", "value"), value=4)


def q_depth_section(spark: SparkSession, d: str) -> DataFrame:
    profile = _profile(spark, d, TOMO)
    rows = profile.agg(F.max("iaz")).first()[0] + 1
    shape = replace(t.EVENT_META, n_win_az=rows)
    line = tomography.section(profile, TOMO, shape, (0, 0), (rows - 1, 14), 25)
    return rounded(line, value=4)


def q_geocoded_peaks(spark: SparkSession, d: str) -> DataFrame:
    peaks = tomography.window_peaks(_profile(spark, d, TOMO), TOMO)
    layout = TrackParams(win_az=16, win_rg=16, stride_az=16, stride_rg=16)
    found = commands.placed_windows(peaks, Grid(n_x=97, n_y=257), layout, PLANE)
    return rounded(found.select(
        F.col("window").alias("win"), F.col("lat_deg").alias("lat"), F.col("lon_deg").alias("lon"),
        F.col("plane_hae_m").alias("plane_hae"), F.col("peak_depth_m").alias("peak_depth"), F.col("peak_hae_m").alias("peak_hae"),
    ), plane_hae=3, peak_hae=3)


# -- change, validation, nulls, display ----------------------------------------------


def q_change_map(spark: SparkSession, d: str) -> DataFrame:
    pixels = t.film_pixels(spark, d).withColumn("look", F.col("film") * t.FILM_LOOKS + F.col("look"))
    return rounded(ccd.change_map(pixels, t.FILM_AZ, t.FILM_RG, CHANGE))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return t.table(spark, d, "orders").select(
        "o_orderkey",
        (c("o_totalprice") / 15000.0).alias("dwell_s"), F.lit(8800.0).alias("prf_hz"),
        F.lit(0.0305).alias("lambda_m"), F.lit(640000.0).alias("slant_range_m"),
        F.lit(7410.0).alias("v_platform_ms"), F.lit(0.61).alias("incidence_rad"),
        c("o_custkey").cast("double").alias("n_pulse"), F.lit(4096.0).alias("n_rbin"),
        F.lit(8740.0).alias("prf_min_hz"),
        (F.lit(8740.0) + c("o_custkey") % 700).alias("prf_max_hz"),
        F.lit(0.00097).alias("worst_gap_s"),
        ((c("o_orderkey") % 40) / 8.0 - 0.5).alias("target_freq_hz"),
        ((c("o_orderkey") % 7) / 1000.0).alias("target_amp_m"),
        ((c("o_custkey") % 17 + 1) / 200.0).alias("alpha"),
        ((c("o_custkey") % 10) / 10.0).alias("overlap"), F.lit(40.0).alias("upsample"),
        F.lit(1.0).alias("cell_m"), F.lit(128.0).alias("grid_n"), F.lit(32.0).alias("win"),
        ((c("o_orderkey") % 9) / 20.0).alias("coherence_min"),
    )


def q_validate_findings(spark: SparkSession, d: str) -> DataFrame:
    found = validation.findings(_requests(spark, d), ["o_orderkey"])
    return rounded(found.select("o_orderkey", "check", "level", "figure_1", "figure_2", "figure_3"), figure_2=4)


def q_validate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return validation.verdict(validation.findings(_requests(spark, d), ["o_orderkey"]), ["o_orderkey"])


def q_pri_percentiles(spark: SparkSession, d: str) -> DataFrame:
    pulses = t.table(spark, d, "events").select(
        F.col("event_id").alias("pulse"), (t.micros("ts") / 1000000.0).alias("t")
    )
    return rounded(validation.interval_percentiles(validation.pulse_intervals(pulses)))


def q_shuffle_null(spark: SparkSession, d: str) -> DataFrame:
    params = replace(TRACK, coherence_min=0.0)
    runs = nulls.prominences(t.film_stack(spark, d), params, 4, keys=["film"])
    return rounded(nulls.null_summary(runs, 5.0))


def q_quicklook(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.quicklook(t.image_pixels(spark, d)))


def q_frequency_map(spark: SparkSession, d: str) -> DataFrame:
    shown = raster.map_levels(_spectra(spark, d), "dominant_freq", palette="energy")
    return rounded(shown.select("win", "level", "r", "g", "b"))


def q_crop(spark: SparkSession, d: str) -> DataFrame:
    meta = replace(IMAGE, n_rg=1 << 40)
    cut, _ = raster.crop(t.image_pixels(spark, d), meta, 8, 0, 16, 1 << 40)
    return rounded(cut.groupBy("az").agg(
        F.count(F.lit(1)).alias("n"), F.avg("re").alias("mre"), F.avg("im").alias("mim")
    ))


def q_collect_info(spark: SparkSession, d: str) -> DataFrame:
    """What a collect is, from one pass over its pulses."""
    collect = t.pulse_table(spark, d)
    return rounded(commands.collect_facts(collect))


QUERIES: dict[str, Query] = {
    "acoustic_wavelength": q_acoustic_wavelength,
    "resolution_grid": q_resolution_grid,
    "tomographic_wavenumber": q_tomographic_wavenumber,
    "depth_scales": q_depth_scales,
    "conditioning": q_conditioning,
    "feasibility": q_feasibility,
    "band_shape": q_band_shape,
    "doppler_polynomial": q_doppler_polynomial,
    "orbit_interp": q_orbit_interp,
    "orbit_asof": q_orbit_asof,
    "scene_places": q_scene_places,
    "azimuth_resolutions": q_azimuth_resolutions,
    "collect_shape": q_collect_shape,
    "pulses_to_depth": q_pulses_to_depth,
    "image_faults": q_image_faults,
    "ecf_llh_roundtrip": q_ecf_llh_roundtrip,
    "plane_offset": q_plane_offset,
    "project_to_height": q_project_to_height,
    "slant_to_ground": q_slant_to_ground,
    "azimuth_power": q_azimuth_power,
    "doppler_centroid": q_doppler_centroid,
    "doppler_bandwidth": q_doppler_bandwidth,
    "spectral_split": q_spectral_split,
    "paired_split": q_paired_split,
    "sliding_subapertures": q_sliding_subapertures,
    "backproject": q_backproject,
    "backproject_sinc": q_backproject_sinc,
    "window_geometry": q_window_geometry,
    "pulses_to_spectrum": q_pulses_to_spectrum,
    "track_first": _tracked("first"),
    "track_adjacent": _tracked("adjacent"),
    "track_lag": _tracked("lag"),
    "track_pair": _tracked("pair"),
    "track_phase": q_phase_track,
    "track_splitband": q_splitband_track,
    "track_exhaustive": q_exhaustive_track,
    "patch_demean": q_patch_demean,
    "reference_series": q_reference_series,
    "common_mode_removed": q_common_mode_removed,
    "spectrum_psd": q_spectrum_psd,
    "window_spectrum": q_window_spectrum,
    "displacement_spectrum": q_displacement_spectrum,
    "best_window": q_best_window,
    "consensus": q_consensus,
    "window_evidence": q_window_evidence,
    "largest_block": q_largest_block,
    "eligible_blocks": q_eligible_blocks,
    "selection_report": q_selection_report,
    "shift_statistics": q_shift_statistics,
    "strongest_windows": q_strongest_windows,
    "control_report": q_control_report,
    "model_a_profile": _cells(TOMO),
    "model_a_lstsq_profile": _cells(replace(TOMO, solver="lstsq", depth_max=10.0)),
    "model_b_profile": _cells(STANDING),
    "model_c_profile": _cells(MULTIPASS),
    "model_d_profile": _cells(RESONANCE),
    "window_peaks": q_window_peaks,
    "profile_peak": q_profile_peak,
    "stack_contrast": q_stack_contrast,
    "alignment_null": q_alignment_null,
    "sweep": q_sweep,
    "sweep_resonance": q_sweep_resonance,
    "sweep_realisations": q_sweep_realisations,
    "sweep_merge": q_sweep_merge,
    "sweep_fit": q_sweep_fit,
    "depth_slice": q_depth_slice,
    "depth_section": q_depth_section,
    "geocoded_peaks": q_geocoded_peaks,
    "change_map": q_change_map,
    "validate_findings": q_validate_findings,
    "validate_verdict": q_validate_verdict,
    "pri_percentiles": q_pri_percentiles,
    "shuffle_null": q_shuffle_null,
    "quicklook": q_quicklook,
    "frequency_map": q_frequency_map,
    "crop": q_crop,
    "collect_info": q_collect_info,
}

