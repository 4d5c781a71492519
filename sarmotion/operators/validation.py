"""Can a collect support the measurement?  Arithmetic on its geometry, per request row.

A request row has: dwell_s, prf_hz, lambda_m, slant_range_m, v_platform_ms,
incidence_rad, n_pulse, n_rbin, prf_min_hz, prf_max_hz, worst_gap_s,
target_freq_hz, target_amp_m, alpha, overlap, upsample, cell_m, grid_n, win and
coherence_min.  Every check becomes one finding row; a check that does not apply
gives none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import validate_floor_px
from ..functions.joins import attach
from ..functions.ranks import Rank, order_statistics
from ..params import ImageMeta, ValidateDefaults
from .focus import Collect

# Published operating limits of the method.
ETA_GOOD = 0.20
TRACK_FLOOR_PX = 7.0
ALPHA_LO = 0.045
ALPHA_HI = 0.076

REQUEST = (
    "dwell_s", "prf_hz", "lambda_m", "slant_range_m", "v_platform_ms", "incidence_rad",
    "n_pulse", "n_rbin", "prf_min_hz", "prf_max_hz", "worst_gap_s", "target_freq_hz",
    "target_amp_m", "alpha", "overlap", "upsample", "cell_m", "grid_n", "win", "coherence_min",
)

LEVELS = ("PASS", "WARN", "FAIL", "UNKNOWN")


def _level(fail: Column, warn: Column | None = None) -> Column:
    out = F.when(fail, "FAIL")
    if warn is not None:
        out = out.when(warn, "WARN")
    return out.otherwise("PASS")


def _ratio(a: Column, b: Column) -> Column:
    """Quotient, NULL over zero: a request may hold any numbers."""
    return F.try_divide(a, b)


def coherence_floor(alpha: Column, overlap: Column) -> tuple[Column, Column]:
    """(looks, mean shared band fraction over all look pairs), in closed form.

    Looks d apart share 1 - d(1 - overlap) of their band while that is positive.
    """
    step = 1.0 - overlap
    exact = _ratio(_ratio(F.lit(1.0), alpha) - overlap, step)
    n = F.when(exact > 1, F.floor(exact + 0.5)).otherwise(F.lit(0)).cast("double")
    d = F.least(n - 1, F.ceil(_ratio(F.lit(1.0), step)) - 1).cast("double")
    s1 = d * (d + 1) / 2.0
    s2 = d * (d + 1) * (2 * d + 1) / 6.0
    shared = n * d - (1.0 + n * step) * s1 + step * s2
    return n, _ratio(shared, n * (n - 1) / 2.0)


def _derived(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests with every quantity more than one check uses, computed once."""
    c = F.col
    excess = _ratio(F.lit(1.0), c("alpha")) - c("overlap")
    exact = _ratio(excess, 1.0 - c("overlap"))
    spaced = (c("overlap") < 1) & (c("alpha") > 0) & (excess > 0)
    looks, floor_g = coherence_floor(c("alpha"), c("overlap"))
    stages = [
        {
            "t_sap": c("alpha") * c("dwell_s"),
            "looks": F.when(spaced, exact).otherwise(0.0),
            "n_looks": looks,
            "shared": floor_g,
            "swing": c("slant_range_m") * 2.0 * math.pi * c("target_freq_hz") * F.cos("incidence_rad"),
        },
        {
            "step": F.when(
                c("looks") > 1, _ratio(c("dwell_s") - c("t_sap"), c("looks") - 1.0)
            ).otherwise(c("dwell_s")),
            "eta": c("target_freq_hz") * c("t_sap"),
            "res_sap": _ratio(c("lambda_m") * c("slant_range_m"), 2.0 * c("v_platform_ms") * c("t_sap")),
            "a_min": F.when(
                c("swing") > 0, _ratio(0.5 * TRACK_FLOOR_PX * c("cell_m") * c("v_platform_ms"), c("swing"))
            ).otherwise(F.lit(math.inf)),
        },
        {
            "f_max": _ratio(F.lit(0.5), F.when(c("t_sap") > 0, c("t_sap")).otherwise(c("step"))),
            "whole": F.floor(c("eta") + 0.5),
            "ceiling": _ratio(1.5 * c("res_sap"), c("cell_m")),
            "independent": F.greatest(_ratio(c("win") * c("cell_m"), c("res_sap")), F.lit(1.0)) * c("win"),
        },
        {"distance": F.when(c("whole") >= 1, F.abs(c("eta") - c("whole"))).otherwise(c("eta"))},
    ]
    out = requests.select(*keys, *REQUEST)
    for stage in stages:
        out = out.withColumns(stage)
    return out


def findings(requests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per request and applicable check: ``(*keys, ord, check, level, detail, figure_1, figure_2, figure_3)``.

    The checks that apply are exploded as numbers; level, text and figures are then chosen per row, so a text nobody
    selects is never formatted.  The figures are those of the text and: the frequency below which the observation
    ratio is good (2 of its check), the first three blind frequencies, the least and greatest admissible
    amplitude (2 and 3 of ambiguity), the share of look pairs with a common band (2 of the gate) and the line-of-sight
    noise (3 of the phase floor).
    """
    c = F.col
    f, gate, t_sap, eta = c("target_freq_hz"), c("coherence_min"), c("t_sap"), c("eta")
    usable = (
        (c("dwell_s") > 0) & (c("lambda_m") > 0) & (c("slant_range_m") > 0) & (c("v_platform_ms") > 0)
    )
    targeted, always = f > 0, F.lit(True)
    need = F.floor(2.0 * c("looks") + 0.5)
    spread = _ratio(100.0 * (c("prf_max_hz") - c("prf_min_hz")), c("prf_hz"))
    gaps = F.when(c("prf_hz") > 0, c("worst_gap_s") * c("prf_hz")).otherwise(0.0)
    margin = _ratio(c("target_amp_m"), c("a_min"))
    per_amp = _ratio(c("swing"), c("v_platform_ms"))
    bounds = [_ratio(0.5 * TRACK_FLOOR_PX * c("cell_m"), per_amp), _ratio(0.5 * c("ceiling") * c("cell_m"), per_amp)]
    admissible = c("target_amp_m").between(*bounds)
    # Looks up to ``last`` steps apart share part of their band.
    last = F.least(c("n_looks") - 1, F.ceil(_ratio(F.lit(1.0), 1.0 - c("overlap"))) - 1)
    paired = _ratio(last * c("n_looks") - last * (last + 1) / 2.0, c("n_looks") * (c("n_looks") - 1) / 2.0)
    phase_sd = _ratio(F.sqrt(1.0 - gate * gate), gate * F.sqrt(2.0 * c("independent")))
    whole, distance, say = c("whole"), c("distance"), F.format_string

    # (check, applies, level, detail, figures) in report order.
    checks = [
        ("metadata", None, _level(~usable),
         say("dwell %.3f s, wavelength %.4f m, range %.1f km, speed %.0f m/s", c("dwell_s"),
             c("lambda_m"), c("slant_range_m") / 1000.0, c("v_platform_ms")),
         [c("dwell_s"), c("slant_range_m") / 1000.0, c("v_platform_ms")]),
        ("frequency_resolution", targeted, _level(f * c("dwell_s") < 3.0),
         say("%.4f Hz resolution; the target is %.1f bins from zero", _ratio(F.lit(1.0), c("dwell_s")), f * c("dwell_s")),
         [_ratio(F.lit(1.0), c("dwell_s")), f * c("dwell_s")]),
        ("observable_band", always, _level((f > 0) & (f >= c("f_max"))),
         say("%.0f sub-apertures reach %.3f Hz; their step alone would suggest %.3f Hz",
             c("looks"), c("f_max"), _ratio(F.lit(0.5), c("step"))),
         [c("f_max"), _ratio(F.lit(0.5), c("step")), c("looks")]),
        ("grid_width", always, _level(c("grid_n") < need),
         say("a spectral split needs %d azimuth lines, the grid has %d", need, c("grid_n").cast("bigint")),
         [need, c("grid_n")]),
        ("observation_ratio", targeted, _level(F.lit(False), eta > ETA_GOOD),
         say("sub-aperture %.4f s at %.3f Hz observes %.3f of a cycle", t_sap, f, eta),
         [eta, _ratio(F.lit(ETA_GOOD), t_sap), t_sap]),
        ("averaging_null", targeted & (t_sap > 0),
         _level((whole >= 1) & (distance < 0.10), (whole >= 1) & (distance < 0.20)),
         say("%.3f of a cycle from the nearest blind frequency", distance),
         [_ratio(F.lit(float(k)), t_sap) for k in (1, 2, 3)]),
        ("aperture_fraction", always, _level(F.lit(False), ~c("alpha").between(ALPHA_LO, ALPHA_HI)),
         say("aperture fraction %.3f%%, published range %.1f-%.1f%%", 100.0 * c("alpha"),
             F.lit(100 * ALPHA_LO), F.lit(100 * ALPHA_HI)),
         [c("alpha"), F.lit(ALPHA_LO), F.lit(ALPHA_HI)]),
        ("prf_stability", (c("prf_min_hz") > 0) & (c("prf_max_hz") > 0),
         _level(F.lit(False), (gaps > 20.0) | (spread > 5.0)),
         say("pulse rate spans %.2f%%; the largest gap is %.1f intervals", spread, gaps),
         [spread, gaps]),
        ("sensitivity", targeted & (c("cell_m") > 0) & (c("upsample") > 0),
         F.when(~(c("target_amp_m") > 0), "UNKNOWN").otherwise(_level(margin < 1.0, margin < 3.0)),
         say("detectable from %.3f mm vertical; interpolation alone would allow %.4f px",
             1000.0 * c("a_min"), validate_floor_px(c("upsample"))),
         [c("a_min"), margin, validate_floor_px(c("upsample"))]),
        ("ambiguity", targeted & (c("cell_m") > 0) & (t_sap > 0) & (c("v_platform_ms") > 0),
         _level((c("ceiling") <= TRACK_FLOOR_PX) | ((c("target_amp_m") > 0) & ~admissible)),
         say("shifts wrap at %.1f px against a floor of %.1f px", c("ceiling"), F.lit(TRACK_FLOOR_PX)),
         [c("ceiling"), *bounds]),
        ("coherence_gate",
         (c("alpha") > 0) & (c("overlap") > 0) & (c("overlap") < 1)
         & (c("n_looks") > 1),
         _level((gate > 0) & (gate <= c("shared")), (gate <= 0) | (gate <= 1.5 * c("shared"))),
         say("an incoherent scene still reports %.3f; the mask is %.2f", c("shared"), gate),
         [c("shared"), paired, gate]),
        ("phase_floor",
         (c("win") > 0) & (c("cell_m") > 0) & (t_sap > 0) & (gate > 0) & (c("lambda_m") > 0),
         _level(F.lit(False), c("independent") <= 4.0),
         say("%.0f independent samples bound the phase at %.3f rad", c("independent"), phase_sd),
         [c("independent"), phase_sd, phase_sd * c("lambda_m") / (4.0 * math.pi)]),
        ("memory", (c("n_pulse") > 0) & (c("n_rbin") > 0), F.lit("PASS"),
         say("%.1f GB of complex samples", c("n_pulse") * c("n_rbin") * 8.0 / 1e9),
         [c("n_pulse") * c("n_rbin") * 8.0 / 1e9]),
        ("ground_truth", always, F.lit("UNKNOWN"),
         F.lit("whether anything in the scene moves is not a property of the collect"),
         []),
    ]

    # Unusable geometry ends the list after its first line.
    applicable = F.array_compact(F.array(
        F.lit(0), *[F.when(usable & check[1], F.lit(i)) for i, check in enumerate(checks) if i]
    ))
    # Figures are computed once a request, before its checks are exploded.
    padded = [[x.cast("double") for x in check[4]] + [F.lit(None).cast("double")] * (3 - len(check[4])) for check in checks]
    figures = F.array(*[F.array(*row) for row in padded])
    numbered = _derived(requests, keys).withColumn("_figures", figures).withColumn("ord", F.explode(applicable))

    def chosen(part: int) -> Column:
        out = F.when(c("ord") == 0, checks[0][part])
        for i, check in enumerate(checks[1:], 1):
            out = out.when(c("ord") == i, check[part])
        return out

    names = F.array(*[F.lit(check[0]) for check in checks])
    figure = lambda k: F.element_at("_figures", c("ord") + 1)[k].alias(f"figure_{k + 1}")

    return numbered.select(
        *keys, "ord", F.element_at(names, c("ord") + 1).alias("check"),
        chosen(2).alias("level"), chosen(3).alias("detail"), *[figure(k) for k in range(3)],
    )


def verdict(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst level per request; UNKNOWN never decides it."""
    rank = F.when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARN", 1).otherwise(0)
    worst = found.groupBy(*keys).agg(F.max(rank).alias("_w"))
    return worst.select(
        *keys, F.element_at(F.array(*[F.lit(v) for v in LEVELS[:3]]), F.col("_w") + 1).alias("verdict")
    )


def pulse_intervals(pulses: DataFrame, block: int = 65536) -> DataFrame:
    """Time from each pulse to the next one there is: ``(pulse, pri)``.

    Numbers may be missing: the interval over a gap is the one that matters.  Pulses are ordered within blocks of
    ``block`` numbers; only the first pulse of each block, one row for ``block`` numbers, is ordered across blocks.
    """
    times = pulses.select("pulse", "t", F.floor(F.col("pulse") / block).alias("_block"))
    inside = times.withColumn("_next", F.lead("t").over(Window.partitionBy("_block").orderBy("pulse")))
    firsts = times.groupBy("_block").agg(F.min_by("t", "pulse").alias("_first"))
    after = firsts.select("_block", F.lead("_first").over(Window.orderBy("_block")).alias("_beyond"))
    later = F.coalesce("_next", "_beyond")
    return attach(inside, after, ["_block"]).where(later.isNotNull()).select("pulse", (later - F.col("t")).alias("pri"))


def interval_percentiles(intervals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1st and 99th percentile (by index) and the largest interval."""
    n = F.col("n")
    ranks = {
        "pri_p01": Rank(0.01, F.floor(n / 100)), "pri_p99": Rank(0.99, F.floor(n * 99 / 100)), "longest": Rank(1.0, n - 1),
    }
    return order_statistics(intervals, keys, "pri", ranks).select(
        *keys, "n", "pri_p01", "pri_p99", F.greatest("longest", F.lit(0.0)).alias("worst_gap_s"),
        F.when(F.col("pri_p99") > 0, 1.0 / F.col("pri_p99")).otherwise(0.0).alias("prf_min_hz"),
        F.when(F.col("pri_p01") > 0, 1.0 / F.col("pri_p01")).otherwise(0.0).alias("prf_max_hz"),
    )


def _request_frame(spark, values: dict) -> DataFrame:
    row = {**{k: 0.0 for k in REQUEST}, **vars(ValidateDefaults()), **values}
    return spark.createDataFrame(
        [tuple(float(row[k]) for k in REQUEST)], ", ".join(f"{k} double" for k in REQUEST)
    )


def collect_request(collect: Collect, **overrides) -> DataFrame:
    """The request row a phase history implies; keywords override any field."""
    meta, pulses = collect.meta, collect.geometry
    ends = {
        r["pulse"]: r
        for r in pulses.where(F.col("pulse").isin(0, meta.n_pulse - 1))
        .select("pulse", "t", "px", "py", "pz", "r_ref").collect()
    }
    first, last = ends[0], ends[meta.n_pulse - 1]
    dwell = last["t"] - first["t"]
    where = [[r[c] for c in ("px", "py", "pz")] for r in (first, last)]
    slant = first["r_ref"] if first["r_ref"] > 0 else math.hypot(*where[0])
    values = {
        "dwell_s": dwell, "prf_hz": meta.prf, "lambda_m": meta.wavelength,
        "n_pulse": meta.n_pulse, "n_rbin": meta.n_rbin, "slant_range_m": slant,
        "v_platform_ms": math.dist(*where) / dwell if dwell > 0 else 0.0,
        "incidence_rad": math.acos(min(1.0, abs(first["pz"]) / slant)) if slant > 0 else 0.0,
    }
    if meta.n_pulse > 2:
        pace = interval_percentiles(pulse_intervals(pulses)).first()
        values |= {k: pace[k] for k in ("prf_min_hz", "prf_max_hz", "worst_gap_s")}
    return _request_frame(pulses.sparkSession, {**values, **overrides})


def image_request(spark, meta: ImageMeta, **overrides) -> DataFrame:
    """The request row a focused product's metadata implies."""
    values = {
        "dwell_s": meta.t_dwell, "prf_hz": meta.fs_az, "lambda_m": meta.wavelength,
        "n_pulse": meta.n_az, "n_rbin": meta.n_rg, "slant_range_m": meta.r0,
        "v_platform_ms": meta.v_platform, "incidence_rad": meta.incidence,
    }
    if meta.az_spacing > 0:
        values["cell_m"] = meta.az_spacing
    return _request_frame(spark, {**values, **overrides})
