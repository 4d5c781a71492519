"""The commands, end to end, on a small saved collect."""

import glob
import json
import math
import os
from dataclasses import replace

import numpy as np
import pytest

from sarmotion.__main__ import main
from sarmotion.errors import ArgumentError, RangeFault
from sarmotion.operators.focus import Collect
from sarmotion.params import Grid, ImageMeta, Plane, SubapParams, Target, TomoParams, TrackParams
from sarmotion.plans import feasibility as feasible
from sarmotion.plans import commands
from sarmotion.sources import interchange
from scenes import clutter, simulate

ECF = (-120301.196, -4594117.3286, 4408300.01)
GRID = Grid(32, 32)
SUBAP = SubapParams(n_looks=16, overlap=0.0)
TRACK = TrackParams(win_az=16, win_rg=16, stride_az=8, stride_rg=8, upsample_az=20, upsample_rg=10, coherence_min=0.0)
TOMO = TomoParams(velocity=3000.0, frequency=2000.0, depth_max=8.0, depth_cell=2.0)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    made = simulate(spark, [Target(0, 0, 0, 1.0, 0.5, 0.02), *clutter(20, 12.0, 0.1)], dwell=8.0, prf=200.0, n_rbin=128)
    plane = Plane(ECF, (1.0, 0.0, 0.0), (0.0, 0.6, 0.8), ref_hae=300.0)
    path = str(tmp_path_factory.mktemp("collect") / "scene")
    interchange.save(Collect(made.pulses, replace(made.meta, plane=plane)), path)
    return path


@pytest.fixture(scope="module")
def collect(spark, saved):
    return interchange.load_collect(spark, saved)


def run(capsys, *argv):
    code = main(list(argv))
    out = capsys.readouterr()
    return code, out.out, out.err


def csv_lines(folder):
    """The header every part repeats, then all rows."""
    parts = [open(p).read().splitlines() for p in sorted(glob.glob(f"{folder}/part-*.csv"))]
    assert len({p[0] for p in parts}) == 1
    return parts[0][:1] + [line for p in parts for line in p[1:]]


CHAIN = ["--n", "16", "--overlap", "0", "--win", "16", "--upsample", "10", "--coherence", "0"]


def test_feasibility(capsys, spark):
    code, out, _ = run(capsys, "feasibility", "--tomo-velocity", "6000", "--tomo-frequency", "12500")
    lines = out.splitlines()
    assert code == 0 and len(lines) == 7 and lines[0].split()[0] == "8"
    assert json.loads(lines[6])["lambda_paper"] == pytest.approx(0.24)
    row = feasible.feasibility(feasible.acquisition(spark, 10, 5e5, 7500, 0.031)).where("n_looks = 64").first()
    assert (row["f_max"], row["az_resolution"]) == (3.2, pytest.approx(6.62, rel=0.05))


def test_info(capsys, saved):
    code, out, _ = run(capsys, "info", "--cphd", saved)
    told = json.loads(out)
    assert code == 0 and told["pulses"] == 1600 and told["range_bins"] == 128
    assert told["dwell_s"] == pytest.approx(1599 / 200)


def test_validate(capsys, saved):
    code, out, _ = run(capsys, "validate", "--cphd", saved, "--frequency", "0.1", "--amplitude", "20")
    assert "ground_truth" in out and "VERDICT: FAIL" in out and code == 2
    code, out, _ = run(capsys, "validate", "--cphd", saved, "--size", "2048")
    assert code == 0 and "frequency_resolution" not in out


def test_focus(capsys, saved, tmp_path):
    png, raw = str(tmp_path / "a.png"), str(tmp_path / "a.f32")
    code, _, _ = run(capsys, "focus", "--cphd", saved, "--size", "32", "--out", png, "--raw", raw)
    assert code == 0 and open(png, "rb").read(4) == b"\x89PNG"
    amp = np.fromfile(raw, "<f4").reshape(32, 32)
    az, rg = np.unravel_index(amp.argmax(), amp.shape)
    assert abs(az - 15.5) <= 4 and abs(rg - 15.5) <= 2  # it moves
    code, _, err = run(capsys, "focus", "--cphd", saved, "--size", "8", "--out", png, "--pulse-start", "9999")
    assert code == 1 and "outside" in err


def test_mmotion(capsys, saved, tmp_path):
    stem = str(tmp_path / "m")
    code, out, _ = run(
        capsys, "mmotion", "--cphd", saved, "--size", "32", *CHAIN, "--out", stem, "--shifts", stem + "_s.csv",
        "--ccd-out", stem, "--ccd-win", "3", "--null-trials", "2",
    )
    assert code == 0
    told = json.loads(out[out.index("{\n") :])
    assert told["nulls"]["shuffle"]["n_trials"] == 2 and 0 < told["nulls"]["shuffle"]["p_value"] <= 1
    assert told["consensus"]["n_voting"] >= told["consensus"]["n_agree"] > 0
    for name in ("_freq.png", "_quality.png", "_ccd.png", "_ccd.f32", "_windows.json"):
        assert os.path.exists(stem + name)
    windows = csv_lines(stem + "_windows.csv")
    assert windows[0].startswith("window,iaz,irg,dominant_hz") and len(windows) == 10
    shifts = csv_lines(stem + "_s.csv")
    assert shifts[0].startswith("window,look,centre_time_s") and len(shifts) == 1 + 9 * 16


def test_tomo(capsys, saved, tmp_path):
    stem = str(tmp_path / "t")
    code, out, err = run(
        capsys, "tomo", "--cphd", saved, "--size", "32", *CHAIN, "--velocity", "3000", "--frequency", "2000",
        "--depth", "8", "--cell", "4", "--aperture", "60000", "--null-align", "4", "--windows", stem + "_w",
        "--geocode", stem + "_g", "--slice", "4", "--slice-out", stem + "_slice.png", "--section-out",
        stem + "_sec.png", "--section-width", "16", "--out", stem + ".f32",
    )
    assert code == 0, err
    told = json.loads(out)
    assert told["metadata"]["n_depth_cells"] == 3 and told["metadata"]["chain_verdict"] == "conditioned"
    assert "estimator=correlation" in told["metadata"]["measurement_chain"]
    assert told["alignment_null"]["p_value"] <= 1
    assert os.path.getsize(stem + ".f32") == 4 * 9 * 3
    assert len(csv_lines(stem + "_w")) == 10
    placed = csv_lines(stem + "_g")[1:]
    assert all(abs(float(line.split(",")[1]) - 44.0) < 0.01 for line in placed)
    assert open(stem + "_slice.png", "rb").read(4) == open(stem + "_sec.png", "rb").read(4) == b"\x89PNG"


@pytest.mark.parametrize("extra, message", [
    (["--model", "C"], "baselines"), (["--estimator", "phase"], "no shifts"), (["--cell", "0.001"], "finer"),
    (["--velocity", "0"], "assumed"), (["--patent-exact", "--y", "los"], "shift vector"),
])
def test_tomo_refusals(capsys, saved, extra, message):
    code, _, err = run(
        capsys, "tomo", "--cphd", saved, "--velocity", "3000", "--frequency", "2000", "--depth", "8",
        "--cell", "4", *extra,
    )
    assert code == 1 and message in err


def test_patent_conflicts_exit():
    with pytest.raises(SystemExit):
        main(["tomo", "--cphd", "x", "--patent-exact", "--solver", "dft"])


def test_patent_chain_runs(collect):
    params = commands.collect_geometry(collect, replace(TOMO, patent_exact=True, depth_cell=4.0, depth_max=8.0))
    found = commands.tomo(collect, GRID, replace(SUBAP, n_looks=8), TRACK, replace(params, frequency=4000.0))
    assert found.metadata["chain_verdict"] == "patent chain" and found.spectra is None
    assert found.tracking.reference == "pair" and found.profiles.count() == 9
    assert commands.depth_windows(found).count() == 9


def test_sweep(capsys, saved):
    code, out, err = run(
        capsys, "sweep", "--cphd", saved, "--size", "48", "--grid-cell", "1", "--n", "16", "--overlap", "0",
        "--velocity", "3000", "--frequency", "2000", "--depth", "10", "--cell", "5", "--steps", "3",
        "--offsets", "0,0:4,0",
    )
    assert code == 0, err
    told = json.loads(out[out.index("{\n") :])
    assert len(told["realisations"]) == 2 and told["verdict"] != "single_realisation"


def test_geometry_of_a_collect(collect):
    got = commands.collect_geometry(collect, TOMO)
    assert got.aperture == pytest.approx(7500 * 1599 / 200)
    assert got.slant_range == pytest.approx(math.hypot(350000, 500000), rel=1e-6)
    assert got.incidence == pytest.approx(math.acos(500000 / got.slant_range))


def test_resolve_at(spark, collect):
    x, y, _ = commands.resolve_at(spark, collect, 44.0, -91.5)
    assert math.hypot(x, y) < 1.0
    with pytest.raises(RangeFault):
        commands.resolve_at(spark, collect, 95.0, 0.0)


@pytest.mark.parametrize("route", ["uniform", "paper"])
def test_spectral_routes(collect, route):
    stack, motion, meta = commands.observe(collect, Grid(48, 24), replace(SUBAP, n_looks=8), TRACK, route)
    assert meta.n_looks == 8 and stack.meta.doppler_bandwidth > 0
    assert motion.select("look").distinct().count() == 8


def test_pair_defaults_to_the_paper_layout(collect):
    with pytest.raises(ArgumentError):
        commands.observe(collect, Grid(48, 24), replace(SUBAP, n_looks=8, pair=True), TRACK, "uniform")


def test_verdicts():
    blank = commands.Sweep(None, None, {}, [], None, None)
    assert commands.sweep_verdict(blank) == "single_realisation"
    for slope, corr, word in ((1.0, 0.99, "follows_assumption"), (0.0, -0.9, "pinned_by_data"), (0.5, 0.5, "ambiguous"), (None, None, "too_few_wavelengths")):
        fit = {"slope": slope, "correlation": corr}
        assert commands.sweep_verdict(replace(blank, reliable=fit)) == word


def test_cautions_about_sampling(collect):
    assert commands.sampling_warning(collect, Grid(8, 8, 9.0, 9.0), 1.0)
    assert commands.sampling_warning(collect, GRID, 1.0) is None
    _, image = commands.focus(collect, Grid(4, 4))
    want = collect.meta.wavelength * image.r0 * 200.0 / (2 * 7500.0)
    assert commands.unambiguous_extent(collect, image) == pytest.approx(want, rel=1e-6)


def test_scene_places_lie_on_the_reference_height(spark):
    flat = Plane(ECF, (1.0, 0.0, 0.0), (0.0, 0.6, 0.8), ref_hae=300.0)
    meta = ImageMeta(n_az=101, n_rg=51, az_spacing=2.0, rg_spacing=3.0, plane=flat)
    found = {r["place"]: r for r in commands.scene_places(spark, meta).collect()}
    assert set(found) == {"first", "last", "last_azimuth", "last_range", "centre"}
    assert (found["first"]["lat"], found["first"]["lon"]) == pytest.approx((44.0, -91.5), abs=1e-6)
    assert found["centre"]["lat"] == pytest.approx(0.5 * (found["first"]["lat"] + found["last"]["lat"]), abs=1e-6)
    # Seen from the side, a tilted plane's pixels come down to the ground.
    up = np.asarray(ECF) / np.linalg.norm(ECF)
    sensor = tuple(np.asarray(ECF) + 500e3 * up + np.array([0.0, 250e3, 250e3]))
    slant = Plane(ECF, (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), 300.0, True, sensor, (7500.0, 0.0, 0.0))
    placed = commands.scene_places(spark, replace(meta, plane=slant)).collect()
    assert [r["hae"] for r in placed] == pytest.approx([300.0] * 5, abs=0.01)
    assert commands.scene_places(spark, replace(meta, plane=None)).count() == 0
