import json
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarmotion.errors import ArgumentError
from sarmotion.operators import ccd, raster, validation
from sarmotion.operators import subaperture as sub
from sarmotion.params import CcdParams, Grid, ImageMeta, SubapParams, Target
from sarmotion.sinks import images, tables
from scenes import simulate


def pixels(spark, cube):
    rows = [
        (k, a, r, float(v.real), float(v.imag))
        for k, image in enumerate(cube) for a, line in enumerate(image) for r, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, "look bigint, az int, rg int, re double, im double")


def brute_map(cube, win, loading):
    n, rows, cols = cube.shape
    half, load = win // 2, loading * np.mean(np.abs(cube) ** 2) * win * win
    out = np.zeros((rows, cols))

    def cov(x, y):
        v = np.stack([x.ravel(), y.ravel()])
        return v @ v.conj().T + load * np.eye(2)

    for r in range(half, rows - half):
        for c in range(half, cols - half):
            box = np.s_[r - half : r - half + win, c - half : c - half + win]
            ratios = []
            for m in range(1, n - 1):
                e = np.linalg.eigvals(
                    cov(cube[m - 1][box], cube[m][box]) @ np.linalg.inv(cov(cube[m][box], cube[m + 1][box]))
                ).real
                ratios.append(e.max() / e.min())
            out[r, c] = np.mean(ratios)
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(11)
    return rng.normal(size=(6, 11, 9)) + 1j * rng.normal(size=(6, 11, 9))


@pytest.mark.parametrize("win, tile, looks", [(3, 256, 32), (5, 4, 2), (4, 5, 3)])
def test_change_map_matches_eigenvalues(spark, noise, win, tile, looks):
    params = CcdParams(win=win, tile=tile, looks_per_task=looks)
    got = np.zeros((11, 9))
    for r in ccd.change_map(pixels(spark, noise), 11, 9, params, 6).collect():
        got[r["az"], r["rg"]] = r["stat"]
    assert np.allclose(got, brute_map(noise, win, params.loading))


def test_change_map_ignores_scale(spark, noise):
    a, b = (
        ccd.change_map(pixels(spark, k * noise), 11, 9, CcdParams()).orderBy("az", "rg").toPandas()["stat"]
        for k in (1.0, 37.5)
    )
    assert np.abs(a - b).max() < 1e-6 * a.max()


def test_change_refusals(spark, noise):
    image = pixels(spark, noise[:2])
    for args in ((image, 11, 9, CcdParams(), 2), (image, 3, 9, CcdParams(), 6),
                 (image, 11, 9, CcdParams(win=0), 6), (image, 11, 9, CcdParams(statistic="g13"), 6)):
        with pytest.raises(ArgumentError):
            ccd.change_map(*args)


def test_vibration_shows_against_a_static_twin(spark):
    targets = [Target(-20.0, 0.0, 0.0, 1.0, 2.0, 0.005), Target(20.0, 0.0)]
    collect = simulate(spark, targets)
    stack = sub.build(collect, Grid(96, 48), SubapParams(n_looks=156, overlap=0.81))
    kept = stack.pixels.persist()
    near = ccd.change_map(kept, 96, 48, CcdParams(), 156).toPandas()

    def patch(x):
        inside = ((near["az"] - (47.5 + x)).abs() <= 3) & ((near["rg"] - 23.5).abs() <= 3)
        return near[inside]["stat"].mean()

    assert patch(-20.0) > 1.5 * patch(20.0) and patch(20.0) < 1.3


BASE = dict(
    dwell_s=30.0, prf_hz=8800.0, lambda_m=0.0305, slant_range_m=640000.0, v_platform_ms=7410.0,
    incidence_rad=np.radians(35.0), n_pulse=264000.0, n_rbin=3000.0, prf_min_hz=8740.0,
    prf_max_hz=8830.0, worst_gap_s=8 / 8800.0,
)


def levels(spark, **changes):
    request = validation._request_frame(spark, {**BASE, **changes})
    found = validation.findings(request)
    return {r["check"]: r["level"] for r in found.collect()}, validation.verdict(found).first()["verdict"]


def test_geometry_only(spark):
    found, verdict = levels(spark)
    assert set(found) == {
        "metadata", "observable_band", "grid_width", "aperture_fraction", "prf_stability",
        "coherence_gate", "phase_floor", "memory", "ground_truth",
    }
    assert found["ground_truth"] == "UNKNOWN" and found["prf_stability"] == "PASS"
    assert verdict in ("PASS", "WARN")


@pytest.mark.parametrize("changes, check, level", [
    ({"dwell_s": 0.0}, "metadata", "FAIL"),
    ({"target_freq_hz": 0.05}, "frequency_resolution", "FAIL"),
    ({"target_freq_hz": 0.25}, "frequency_resolution", "PASS"),
    ({"target_freq_hz": 0.4}, "observable_band", "FAIL"),
    ({"grid_n": 16.0}, "grid_width", "FAIL"),
    ({"target_freq_hz": 0.3}, "observation_ratio", "WARN"),
    ({"target_freq_hz": 1.0 / (0.05 * 30.0)}, "averaging_null", "FAIL"),
    ({"alpha": 0.2}, "aperture_fraction", "WARN"),
    ({"worst_gap_s": 25 / 8800.0}, "prf_stability", "WARN"),
    ({"target_freq_hz": 0.25, "target_amp_m": 1e-6}, "sensitivity", "FAIL"),
    ({"target_freq_hz": 0.25, "target_amp_m": 1.0}, "sensitivity", "PASS"),
    ({"target_freq_hz": 0.25}, "sensitivity", "UNKNOWN"),
    ({"target_freq_hz": 0.25, "cell_m": 5.0}, "ambiguity", "FAIL"),
    ({"coherence_min": 0.01, "overlap": 0.8}, "coherence_gate", "FAIL"),
    ({"coherence_min": 0.0}, "coherence_gate", "WARN"),
    ({"win": 1.5}, "phase_floor", "WARN"),
])
def test_each_check(spark, changes, check, level):
    assert levels(spark, **changes)[0][check] == level


@pytest.mark.parametrize("field", ["alpha", "cell_m", "prf_hz", "v_platform_ms", "win", "upsample", "grid_n"])
def test_zero_fields_never_divide(spark, field):
    found, _ = levels(spark, **{field: 0.0}, target_freq_hz=0.25, target_amp_m=0.001)
    assert "metadata" in found


def test_full_overlap_is_survived(spark):
    assert "coherence_gate" not in levels(spark, overlap=1.0)[0]


def test_unusable_geometry_stops_the_list(spark):
    found, verdict = levels(spark, dwell_s=0.0)
    assert list(found) == ["metadata"] and verdict == "FAIL"


@pytest.mark.parametrize("alpha, overlap", [(0.05, 0.4), (0.1, 0.75), (0.3, 0.2), (0.02, 0.9)])
def test_coherence_floor_is_the_pair_mean(value, alpha, overlap):
    n, floor = (value(c) for c in validation.coherence_floor(F.lit(alpha), F.lit(overlap)))
    d = np.arange(1, int(n))
    share = np.maximum(1 - d * (1 - overlap), 0)
    assert floor == pytest.approx(((n - d) * share).sum() / (n - d).sum())


def test_collect_request_reads_the_pulses(spark):
    collect = simulate(spark, [Target(0.0, 0.0)], dwell=1.0, prf=400.0)
    row = validation.collect_request(collect).first()
    assert row["dwell_s"] == pytest.approx(399 / 400)
    assert row["v_platform_ms"] == pytest.approx(7500.0)
    assert row["prf_min_hz"] == pytest.approx(400.0) and row["prf_max_hz"] == pytest.approx(400.0)


def test_image_request_takes_the_products_cell(spark):
    meta = ImageMeta(n_az=10, n_rg=5, fs_az=100.0, wavelength=0.03, az_spacing=0.7, t_dwell=9.0)
    row = validation.image_request(spark, meta, alpha=0.06).first()
    assert (row["cell_m"], row["alpha"], row["n_pulse"]) == (0.7, 0.06, 10.0)


# -- display ----------------------------------------------------------------------


def png_pixels(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        head = struct.unpack(">IIBB", part[:10]) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    cols, rows, depth, colour = head
    assert depth == 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, -1)
    assert (lines[:, 0] == 0).all()
    return lines[:, 1:].reshape(rows, cols, 3) if colour == 2 else lines[:, 1:]


def test_png_round_trip():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (png_pixels(images.encode_png(grey)) == grey).all()
    colour = np.random.default_rng(1).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    assert (png_pixels(images.encode_png(colour)) == colour).all()
    with pytest.raises(ArgumentError):
        images.encode_png(np.zeros((0, 3)))


def test_quicklook_levels(spark, noise):
    image = pixels(spark, noise[:1]).drop("look")
    amp = np.abs(noise[0])
    hi = np.sort(amp.ravel())[int((amp.size - 1) * 0.99)]
    want = np.floor(np.clip(1 + 20 * (np.log10(amp) - np.log10(hi)) / 40.0, 0, 1) * 255 + 0.5)
    for r in raster.quicklook(image).collect():
        assert r["level"] == want[r["az"], r["rg"]]


def test_map_levels_and_palettes(spark):
    cells = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 10.0), (3, float("nan"))], "i int, v double")
    auto = {r["i"]: r["level"] for r in raster.map_levels(cells, "v").collect()}
    assert auto == {0: 0, 1: 128, 2: 255, 3: 0}
    fixed = {r["i"]: r["level"] for r in raster.map_levels(cells, "v", 0.0, 20.0).collect()}
    assert fixed[2] == 128
    painted = {r["i"]: (r["r"], r["g"], r["b"]) for r in raster.map_levels(cells, "v", palette="viridis").collect()}
    assert painted[0] == raster.PALETTES["viridis"][0] and painted[2] == raster.PALETTES["viridis"][15]
    flat = spark.createDataFrame([(0, 3.0)], "i int, v double")
    assert raster.map_levels(flat, "v").first()["level"] == 0
    assert raster.palette_from_name("grey") == "gray"
    assert raster.palette_from_name("nope", "jet") == "jet"


def test_crop_moves_range_and_time(spark, noise):
    meta = ImageMeta(n_az=11, n_rg=9, azimuth_time_interval=0.1, rg_spacing=2.0, r0=100.0)
    cut, small = raster.crop(pixels(spark, noise[:1]), meta, 2, 3, 100, 4)
    assert (small.n_az, small.n_rg, small.r0) == (9, 4, 106.0)
    assert small.t0 == pytest.approx(0.2) and small.t_dwell == pytest.approx(0.9)
    assert cut.count() == 36
    with pytest.raises(ArgumentError):
        raster.crop(pixels(spark, noise[:1]), meta, 11, 0, 1, 1)


def test_images_in_one_file_or_tiles(spark, tmp_path):
    values = np.arange(60).reshape(10, 6)
    cells = spark.createDataFrame(
        [(int(a), int(r), int(values[a, r])) for a in range(10) for r in range(6)], "az int, rg int, level int"
    )
    one = str(tmp_path / "one.png")
    images.export_image(cells, 10, 6, one)
    assert (png_pixels(open(one, "rb").read()) == values).all()
    pgm = str(tmp_path / "one.pgm")
    images.export_image(cells, 10, 6, pgm)
    assert open(pgm, "rb").read() == b"P5\n6 10\n255\n" + values.astype(np.uint8).tobytes()
    # The written table has one form, whatever the image's size.
    for tile in (4, 512):
        path = str(tmp_path / f"tiles{tile}")
        images.write_image(cells, 10, 6, path, tile=tile)
        tiles = {(r["tile_row"], r["tile_col"]): png_pixels(bytes(r["data"])) for r in spark.read.parquet(path).collect()}
        rows = range(-(-10 // tile))
        assert (np.block([[tiles[r, c] for c in range(-(-6 // tile))] for r in rows]) == values).all()


def test_cube_offsets_and_header(spark, tmp_path):
    path = str(tmp_path / "cube.f32")
    rows = spark.createDataFrame([(w, [float(w), w + 0.5]) for w in range(6)], "w bigint, v array<double>")
    images.write_cube(rows.repartition(4), "w", "v", str(tmp_path / "cube"))
    assert sorted((r["at"], list(r["run"])) for r in spark.read.parquet(str(tmp_path / "cube")).collect()) == [
        (w, [float(w), w + 0.5]) for w in range(6)
    ]
    images.export_cube(rows.repartition(4), "w", "v", 2, 3, 2, path, "a, b, depth")
    got = np.fromfile(path, "<f4").reshape(2, 3, 2)
    assert (got[..., 0].ravel() == np.arange(6)).all() and (got[..., 1] == got[..., 0] + 0.5).all()
    header = open(path + ".hdr").read()
    assert "n_plane 2\nn_row 3\nn_col 2" in header and "axes a, b, depth" in header


def test_json_sidecar(tmp_path):
    path = str(tmp_path / "m.json")
    tables.write_json({"a": 1}, path)
    assert json.load(open(path)) == {"a": 1}


def test_intervals_span_missing_pulses(spark):
    frame = spark.createDataFrame([(n, float(n)) for n in (0, 1, 3, 4, 70_000)], "pulse bigint, t double")
    found = {r["pulse"]: r["pri"] for r in validation.pulse_intervals(frame).collect()}
    assert found == {0: 1.0, 1: 2.0, 3: 1.0, 4: 69_996.0}
    few = validation.pulse_intervals(frame.where("pulse < 5"), block=2)
    assert sorted(r["pri"] for r in few.collect()) == [1.0, 1.0, 2.0]


def test_ccd_params_are_plain(noise):
    assert replace(CcdParams(), win=7).win == 7


def test_cube_parts_and_manifest_in_another_store(spark, tmp_path):
    """Tasks write parts, runs that no row gives read as absent, and a second export replaces the first."""
    import os

    from sarmotion.sinks import cubes

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "store_handlers.py"))
    spark.conf.set("spark.sarmotion.store.far", "store_handlers:opened")
    path = f"far://{tmp_path}/cube"
    for shift in (0.0, 100.0):
        rows = spark.createDataFrame([(w, [w + shift, w + 0.5]) for w in range(90) if w % 7], "w bigint, v array<double>")
        cubes.export_cube(rows.repartition(5), "w", "v", 3, 30, 2, path)
        got = {r["at"]: list(r["run"]) for r in cubes.read_cube(spark, path).collect()}
        assert got == {w: [w + shift, w + 0.5] for w in range(90) if w % 7}
    names = os.listdir(tmp_path / "cube")
    assert "cube.hdr" in names and "manifest.json" in names and not [n for n in names if "partial" in n]
    spark.conf.unset("spark.sarmotion.store.far")


def test_flat_cube_is_written_by_tasks_and_read_back(spark, tmp_path):
    from sarmotion.sinks import cubes

    path = str(tmp_path / "c.f32")
    rows = spark.createDataFrame([(w, [float(w), -float(w)]) for w in range(50) if w != 30], "w bigint, v array<double>")
    cubes.export_cube(rows.repartition(7), "w", "v", 1, 50, 2, path)
    want = np.array([[w, -w] if w != 30 else [0, 0] for w in range(50)], float)
    assert (np.fromfile(path, "<f4").reshape(50, 2) == want).all()
    got = sorted((r["at"], list(r["run"])) for r in cubes.read_cube(spark, path).collect())
    assert (np.array([v for _, v in got]) == want).all()


@pytest.mark.parametrize("store", ["flat", "parts"])
def test_failed_export_leaves_nothing(spark, tmp_path, store):
    import os

    from sarmotion.sinks import cubes

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "store_handlers.py"))
    spark.conf.set("spark.sarmotion.store.far", "store_handlers:opened")
    target = tmp_path / "cube"
    path = str(target) if store == "flat" else f"far://{target}"
    rows = spark.range(200).selectExpr("id as w", "array(cast(id as double), 1.0D) as v")
    for bad in (rows, rows.selectExpr("w", "if(w = 77, array(1.0D), v) as v")):  # outside the cube; a short run
        with pytest.raises(Exception, match="lies outside|another length"):
            cubes.export_cube(bad.repartition(4), "w", "v", 1, 190 if bad is rows else 200, 2, path)
        left = [os.path.join(d, n) for d, _, names in os.walk(tmp_path) for n in names]
        assert left == []
    cubes.export_cube(rows, "w", "v", 1, 200, 2, path)
    with pytest.raises(ArgumentError):
        cubes.export_cube(rows, "w", "v", 1, 3, 1, path)
    spark.conf.unset("spark.sarmotion.store.far")
