import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarmotion.errors import ArgumentError, RangeFault
from sarmotion.operators import tomography as tomo
from sarmotion.params import MotionMeta, TomoParams

SCENE = TomoParams(
    velocity=3000.0, frequency=12500.0, slant_range=500000.0, aperture=75000.0,
    depth_cell=0.5, depth_max=20.0, remove_y_mean=False, window=False,
)
META = MotionMeta(n_looks=128, dt=0.1, n_win_az=2, n_win_rg=2)


def frame(spark, vectors):
    """Series rows from complex data vectors, one per window."""
    rows = [
        (w, w // 2, w % 2, 0.9, [float(v) for v in y.real], [float(v) for v in y.imag], [float(v) for v in y.real])
        for w, y in enumerate(vectors)
    ]
    return spark.createDataFrame(
        rows, "win bigint, iaz int, irg int, quality double, disp_az array<double>, "
        "disp_rg array<double>, disp_los array<double>"
    )


def scene(spark, depths, amps, params=SCENE, n=128, windows=4):
    kz = tomo.wavenumber(params, params.aperture * np.arange(n) / n, tomo.acoustic_wavelength(params))
    y = sum(a * np.exp(1j * kz * z) for z, a in zip(depths, amps))
    return frame(spark, [y] * windows)


def peak(spark, series, params, meta=META, baselines=None):
    profile = tomo.profiles(params, meta, series=series, baselines=baselines)
    row = tomo.interpolated_peak(tomo.mean_profile(profile), params.depth_cell).first()
    return row["peak_depth"]


DEEP = replace(SCENE, frequency=12500.0, depth_max=12.5, slant_range=500000.0)


@pytest.mark.parametrize("z", [3.0, 6.0, 9.0, 12.0])
def test_a_scatterer_returns_to_its_depth(spark, z):
    assert peak(spark, scene(spark, [z], [1.0]), DEEP) == pytest.approx(z, abs=tomo.depth_resolution(DEEP))


def test_layers_stand_above_the_mean(spark):
    profile = tomo.profiles(DEEP, META, series=scene(spark, [0, 3, 6], [1.0, 0.8, 0.6])).first()["profile"]
    for z in (3.0, 6.0):
        j = int(z / DEEP.depth_cell)
        assert max(profile[j - 1 : j + 2]) > np.mean(profile[1:])


def test_solvers_agree(spark):
    short = replace(SCENE, depth_max=7.0)
    meta = replace(META, n_looks=32)
    series = scene(spark, [6.0], [1.0], n=32)
    dft = peak(spark, series, short, meta)
    lstsq = peak(spark, series, replace(short, solver="lstsq"), meta)
    assert lstsq == pytest.approx(dft, abs=2 * short.depth_cell)


@pytest.mark.parametrize("n_looks, depth_max", [(128, 12.5), (16, 3.5)])
def test_least_squares_is_the_tikhonov_inverse(spark, n_looks, depth_max):
    params = replace(SCENE, solver="lstsq", depth_max=depth_max, depth_cell=0.4)
    meta = replace(META, n_looks=n_looks)
    rng = np.random.default_rng(8)
    y = rng.normal(size=n_looks) + 1j * rng.normal(size=n_looks)
    got = tomo.profiles(params, meta, series=frame(spark, [y])).first()["profile"]
    a = tomo.steering_matrix(params, n_looks)
    gram = a.conj().T @ a if a.shape[0] >= a.shape[1] else a @ a.conj().T
    mu = params.regularisation * np.trace(gram).real / len(gram)
    # Solve the stacked least-squares problem: independent of the normal equations.
    stacked = np.vstack([a, math.sqrt(mu) * np.eye(a.shape[1])])
    want = np.abs(np.linalg.lstsq(stacked, np.concatenate([y, np.zeros(a.shape[1])]), rcond=None)[0])
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9)


def test_amplitude_only_scales(spark):
    one, ten = (peak(spark, scene(spark, [6.0], [a]), DEEP) for a in (1.0, 10.0))
    assert one == pytest.approx(ten, abs=1e-6)


@pytest.mark.parametrize("height", [10.0, 20.0, 30.0])
def test_baselines_give_heights(spark, height):
    base = np.linspace(0, 1000.0, 24)
    params = replace(SCENE, model="C", aperture=1000.0, depth_cell=8.0, depth_max=60.0)
    kz = tomo.wavenumber(params, base, 0.031)
    series = frame(spark, [np.exp(1j * kz * height)] * 4)
    got = peak(spark, series, params, replace(META, n_looks=24), base)
    assert got == pytest.approx(height, abs=1.5 * tomo.depth_resolution(params))


def test_resonances_land_on_v_over_2f(spark):
    params = replace(SCENE, model="D", velocity=100.0, frequency=0.0, depth_cell=5.0, depth_max=60.0)
    psd = [0.0] * 65
    f = np.arange(65) * META.df
    k = int(np.argmin(np.abs(100.0 / (2 * np.maximum(f, 1e-9)) - 30.0)))
    psd[k] = 4.0
    spectra = spark.createDataFrame([(0, 0, 0, 0.9, psd)], "win bigint, iaz int, irg int, quality double, psd array<double>")
    profile = tomo.profiles(params, META, spectra=spectra).first()["profile"]
    assert int(np.argmax(profile)) == 6
    shared = tomo.resonance_weights(params, f)
    assert set(np.round(shared.sum(axis=0), 12)) <= {0.0, 1.0}  # averages, not sums


def test_standing_waves_match_the_plain_sum(spark):
    params = replace(SCENE, model="B", velocity=100.0, frequency=10.0, depth_cell=20.0, depth_max=60.0)
    rng = np.random.default_rng(9)
    psd = rng.random(65)
    spectra = spark.createDataFrame(
        [(0, 0, 0, 0.9, [float(p) for p in psd])],
        "win bigint, iaz int, irg int, quality double, psd array<double>",
    )
    got = tomo.profiles(params, META, spectra=spectra).first()["profile"]
    sigma = max(tomo.depth_resolution(params), params.depth_cell)
    want = np.zeros(4)
    for k in range(1, 65):
        half = 100.0 / (2 * k * META.df) / 2
        n = 1
        while n * half <= 60.0:
            for j in range(4):
                dz = (j * 20.0 - n * half) / sigma
                if abs(dz) <= 3:
                    want[j] += math.sqrt(psd[k]) * math.exp(-0.5 * dz * dz)
            n += 1
    assert np.allclose(got, want)


@pytest.mark.parametrize("change, error", [
    ({"velocity": 0.0}, ArgumentError),
    ({"velocity": 50.0}, RangeFault),
    ({"frequency": 0.0}, ArgumentError),
    ({"depth_cell": 0.1}, RangeFault),
    ({"depth_cell": 50.0}, ArgumentError),
    ({"depth_max": 0.0}, ArgumentError),
    ({"aperture": 0.0}, ArgumentError),
    ({"incidence": 2.0}, RangeFault),
    ({"eq22_literal_t": 1.0}, ArgumentError),
    ({"eq22_literal_t": -1.0}, ArgumentError),
    ({"model": "Z"}, ArgumentError),
])
def test_parameter_refusals(change, error):
    with pytest.raises(error):
        tomo.check_params(replace(SCENE, **change))


def test_extent_refusals():
    with pytest.raises(RangeFault):
        tomo.focuser(replace(SCENE, depth_max=500.0), META)
    with pytest.raises(RangeFault):
        tomo.focuser(replace(SCENE, model="D", depth_max=1.0), META)
    with pytest.raises(ArgumentError):
        tomo.focuser(replace(SCENE, model="C", aperture=1000.0, depth_cell=8.0), META)
    tomo.check_params(replace(SCENE, eq22_literal_t=0.2, solver="lstsq", depth_cell=1.0))


def test_conventions_differ_by_two():
    patent = replace(SCENE, convention="patent")
    assert tomo.depth_resolution(patent) == pytest.approx(2 * tomo.depth_resolution(SCENE))


def test_conditioning_counts_resolved_cells():
    wide = tomo.conditioning(SCENE, 128, 25)
    assert wide["sv_max"] >= wide["sv_min"] > 0 and 0 < wide["rank"] <= 25
    fine = tomo.conditioning(replace(SCENE, depth_cell=0.01), 128, 25)
    assert fine["rank"] < wide["rank"]
    with pytest.raises(ArgumentError):
        tomo.conditioning(SCENE, 0, 5)


def profile_frame(spark, rows):
    return spark.createDataFrame(
        [(w, w // 2, w % 2, 0.9, [float(v) for v in p]) for w, p in enumerate(rows)],
        "win bigint, iaz int, irg int, quality double, profile array<double>",
    )


def test_contrast_and_alignment(spark):
    aligned = np.ones((40, 16)) * 0.1
    aligned[:, 5] = 3.0
    row = tomo.alignment_null(profile_frame(spark, aligned), 16, 20, seed=3).first()
    assert row["real"] == pytest.approx(30.0) and row["n_ge"] == 0 and row["worst"] < row["real"]
    loose = np.ones((40, 16)) * 0.1
    loose[np.arange(40), np.random.default_rng(1).integers(0, 16, 40)] = 3.0
    assert tomo.alignment_null(profile_frame(spark, loose), 16, 20).first()["n_ge"] > 0
    with pytest.raises(ArgumentError):
        tomo.alignment_null(profile_frame(spark, loose), 16, 0)


def test_window_peak_skips_the_surface(spark):
    rows = tomo.window_peaks(profile_frame(spark, [[9, 1, 4, 4], [9, 0, 0, 0]]), SCENE).orderBy("win").collect()
    assert (rows[0]["peak_bin"], rows[0]["peak_value"]) == (2, 4.0)
    assert rows[1]["peak_bin"] == 1 and rows[1]["peak_value"] == 0.0


def test_parabola_is_clamped_and_exact(spark):
    x = np.arange(8)
    row = tomo.interpolated_peak(
        tomo.mean_profile(profile_frame(spark, [10 - (x - 3.3) ** 2])), 0.5
    ).first()
    assert row["peak_depth"] == pytest.approx(0.5 * 3.3)


def test_slice_and_section(spark):
    frame_ = profile_frame(spark, np.arange(16).reshape(4, 4))
    cut = tomo.nearest_slice(frame_, replace(SCENE, depth_cell=1.0, depth_max=3.0), 1.5)
    assert {r["win"]: r["value"] for r in cut.collect()} == {0: 1.0, 1: 5.0, 2: 9.0, 3: 13.0}
    line = tomo.section(frame_, SCENE, META, (0, 0), (1, 1), 3).where("j = 0").orderBy("sample")
    assert [r["value"] for r in line.collect()] == [0.0, 12.0, 12.0]
    with pytest.raises(ArgumentError):
        tomo.section(frame_, SCENE, META, (0, 0), (1, 1), 1)


def test_sweep_matches_one_run_per_assumption(spark):
    series = scene(spark, [3.0], [1.0])
    params = replace(SCENE, depth_max=8.0, depth_cell=1.0)
    rows = {
        (round(r["velocity"]), round(r["frequency"])): r
        for r in tomo.sweep(params, META, series=series, n_scale=3).collect()
    }
    assert (3000, 12500) in rows
    for (v, f), r in rows.items():
        one = replace(params, velocity=float(r["velocity"]), frequency=float(r["frequency"]))
        assert r["peak_depth"] == pytest.approx(peak(spark, series, one), abs=1e-9)
    with pytest.raises(ArgumentError):
        tomo.sweep(params, META, series=series, n_scale=1)
    with pytest.raises(RangeFault):
        tomo.sweep(replace(params, depth_max=900.0), META, series=series)


def test_sweep_keeps_assumptions_outside_the_spectrum(spark):
    """Slow looks represent deep places only: refused, or a row each with the peak value 0."""
    params = replace(SCENE, model="D", velocity=100.0, depth_max=10.0, depth_cell=5.0, frequency=400.0)
    slow = replace(META, dt=4.0, f_max=0.125)
    spectra = spark.createDataFrame([([1.0] * (slow.n_looks // 2 + 1),)], "psd array<double>")
    with pytest.raises(RangeFault):
        tomo.sweep(params, slow, spectra=spectra, scale_min=1.0, scale_max=2.0, n_scale=2)
    rows = tomo.sweep(params, slow, spectra=spectra, scale_min=1.0, scale_max=2.0, n_scale=2, refuse_outside=False).collect()
    assert len(rows) == 4 and {(r["peak_depth"], r["peak_value"]) for r in rows} == {(5.0, 0.0)}


def test_depth_follows_the_assumed_wavelength(spark):
    """Features fixed in the data land at depths the assumption sets: slope one."""
    series = scene(spark, [6.0], [1.0])
    params = replace(SCENE, depth_max=12.0, depth_cell=0.5)
    rows = tomo.sweep(params, META, series=series, scale_min=0.85, scale_max=1.18, n_scale=5)
    fit = tomo.sweep_summary(rows).first()
    assert fit["n_used"] >= 3 and fit["slope"] == pytest.approx(1.0, abs=0.15)


def sweep_rows(spark, rows):
    return spark.createDataFrame(
        [(v, f, v / (2 * f), d, 1.0) for v, f, d in rows],
        "velocity double, frequency double, lambda_ac double, peak_depth double, peak_value double",
    )


def test_merge_and_fits(spark):
    rows = sweep_rows(spark, [
        (1000.0, 100.0, 5.0), (2000.0, 200.0, 7.0), (2000.0, 100.0, 10.0), (4000.0, 100.0, 20.0),
        (8000.0, 100.0, 40.0), (9000.0, 100.0, -1.0),
    ])
    merged = {round(r["lambda_ac"], 6): r for r in tomo.sweep_merge(rows).collect()}
    assert len(merged) == 4
    assert merged[5.0]["peak_depth"] == 6.0 and merged[5.0]["sd"] == pytest.approx(1.0)
    # Of rows sharing a wavelength the first is fitted, so the line is exact.
    fit = tomo.sweep_summary(rows).first()
    assert (fit["n_used"], fit["slope"], fit["correlation"]) == (4, pytest.approx(1.0), pytest.approx(1.0))
    steady = tomo.sweep_summary_reliable(tomo.sweep_merge(rows), 0.10).first()
    assert steady["n_used"] == 3 and steady["slope"] == pytest.approx(1.0)
    few = tomo.sweep_summary(sweep_rows(spark, [(1000.0, 100.0, 5.0)])).first()
    assert few["slope"] is None
    with pytest.raises(ArgumentError):
        tomo.sweep_summary_reliable(rows, -1.0)


def test_metadata_states_its_chain():
    plain = tomo.metadata(SCENE, META)
    assert plain["chain_verdict"] == "conditioned" and plain["measurement_chain"] == "UNRECORDED"
    exact = replace(
        SCENE, patent_exact=True, convention="patent", solver="lstsq", subap_window=False,
        pair_reference=True, regularisation=0.0, depth_cell=1.0,
    )
    assert tomo.metadata(exact, META)["chain_verdict"] == "patent chain"
    assert tomo.metadata(replace(exact, regularisation=1e-3), META)["chain_verdict"] == "conditioned"


def test_data_vectors():
    meta = replace(META, n_looks=8, az_spacing=2.0)
    az, rg = np.arange(8.0)[None], np.ones((1, 8))
    y = tomo.data_vectors(replace(SCENE, remove_y_mean=True), meta, [az, rg])
    assert np.allclose(y, 2.0 * (az - 3.5))
    los = tomo.data_vectors(replace(SCENE, y_source="los"), meta, [az])
    assert np.allclose(los, az)
    with pytest.raises(ArgumentError):
        tomo.data_columns(replace(SCENE, y_source="phase"))


def test_realigned_stacks_fold_inside_a_task(spark):
    rng = np.random.default_rng(8)
    lines = rng.exponential(size=(40, 7))
    frame = spark.createDataFrame([(w, lines[w].tolist()) for w in range(40)], "win bigint, profile array<double>").coalesce(2)
    parts = tomo.realigned_totals(frame, 7, 5, seed=3)
    assert parts.count() == 2 * 5 * 7
    got = {(r["trial"], r["j"]): r["total"] for r in parts.groupBy("trial", "j").agg(F.sum("total").alias("total")).collect()}
    for trial in range(5):
        want = sum(np.roll(lines[w], tomo.circular_shift(trial, w, 7, 3)) for w in range(40))
        assert [got[trial, j] for j in range(7)] == pytest.approx(want)


def first_seen_groups(rows):
    """Merged groups and the wavelengths that a fit keeps, row by row in order."""
    merged, kept = [], []
    for i, (_, _, lam, depth) in enumerate(rows):
        if not any(abs(g[0] - lam) <= 1e-9 * lam for g in merged):
            own = [d for _, _, x, d in rows if abs(x - lam) <= 1e-9 * lam]
            merged.append((lam, len(own), np.mean(own), np.std(own)))
        if not any(abs(x - lam) <= 1e-9 * lam for _, _, x, _ in rows[:i]):
            kept.append((lam, depth))
    return merged, kept


def test_merge_by_tolerance_at_any_edge(spark):
    """Wavelengths 1e-12 apart are one wherever they lie; chains longer than the tolerance split by first appearance."""
    rng = np.random.default_rng(9)
    rows = []
    for lam in rng.uniform(1.0, 300.0, 300):
        rows += [(lam, rng.uniform(1, 50)), (lam * (1 + 1e-12), rng.uniform(1, 50))]
    for lam in (5.0, 40.0):
        rows += [(lam * (1 + k * 4e-10), rng.uniform(1, 50)) for k in rng.permutation(12)]
    rows = [(float(i), 1.0, float(x), float(d)) for i, (x, d) in enumerate(rows)]
    frame = spark.createDataFrame(
        [(*r, 2.0) for r in rows], "velocity double, frequency double, lambda_ac double, peak_depth double, peak_value double"
    ).repartition(5)
    merged, kept = first_seen_groups(rows)
    assert len(merged) < 320
    got = sorted(tuple(r) for r in tomo.sweep_merge(frame).select("lambda_ac", "n_rows", "peak_depth", "sd").collect())
    assert [g[:2] for g in got] == [m[:2] for m in sorted(merged)]
    assert np.array(got) == pytest.approx(np.array(sorted(merged)), rel=1e-9, abs=1e-6)
    fit = tomo.sweep_summary(frame).first()
    x, y = np.log(np.array(kept)).T
    assert fit["n_used"] == len(kept) and fit["slope"] == pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-9)
