from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarmotion.errors import ArgumentError, MissingMetadata
from sarmotion.operators import focus
from sarmotion.operators import subaperture as sub
from sarmotion.params import Grid, SubapParams, Target
from scenes import simulate, simulate_image


@pytest.fixture(scope="module")
def point(spark):
    collect = simulate(spark, [Target(10.0, 0.0)], dwell=1.0, prf=800.0)
    return focus.Collect(collect.pulses.persist(), collect.meta)


def dense(image, n_az, n_rg):
    out = np.zeros((n_az, n_rg), complex)
    for r in image.collect():
        out[r["az"], r["rg"]] = r["re"] + 1j * r["im"]
    return out


GRID = Grid(64, 64)


def direct(collect, grid, start, stop):
    """Backprojection written out plainly on the driver."""
    rows = collect.pulses.where(F.col("pulse").between(start, stop - 1)).toPandas()
    x = (np.arange(grid.n_x) - 0.5 * (grid.n_x - 1)) * grid.dx
    y = (np.arange(grid.n_y) - 0.5 * (grid.n_y - 1)) * grid.dy
    image = np.zeros((grid.n_x, grid.n_y), complex)
    for _, p in rows.iterrows():
        dist = np.sqrt((p.px - x[:, None]) ** 2 + (p.py - y[None, :]) ** 2 + p.pz**2)
        fbin = (dist - p.r_ref) / collect.meta.dr + collect.meta.n_rbin / 2
        line = np.asarray(p.re) + 1j * np.asarray(p.im)
        bins = np.arange(len(line))
        value = np.interp(fbin, bins, line.real) + 1j * np.interp(fbin, bins, line.imag)
        image += value * np.exp(4j * np.pi / collect.meta.wavelength * dist)
    return image


def test_matches_a_plain_loop(point):
    grid = Grid(12, 10)
    windows = sub.pulse_windows(800, 4, 0.4)
    looks = focus.backproject(point, grid, windows)
    for look in (0, 3):
        got = dense(looks.where(F.col("look") == look), 12, 10)
        start = windows.start(look)
        want = direct(point, grid, start, start + windows.per)
        assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


def test_point_target_focuses_where_it_is(point):
    amp = np.abs(dense(focus.backproject(point, GRID), 64, 64))
    az, rg = np.unravel_index(amp.argmax(), amp.shape)
    assert abs((az - 31.5) - 10.0) <= 1.0 and abs(rg - 31.5) <= 1.0
    assert amp.max() > 20 * np.median(amp)


def test_sinc_keeps_position_and_gains(point):
    linear = np.abs(dense(focus.backproject(point, GRID), 64, 64))
    sinc = np.abs(dense(focus.backproject(point, GRID, range_taps=8), 64, 64))
    assert sinc.max() >= linear.max()
    a, b = (np.unravel_index(m.argmax(), m.shape) for m in (linear, sinc))
    assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1


def test_partitioning_does_not_change_the_image(point):
    once = dense(focus.backproject(point, Grid(8, 8)), 8, 8)
    spread = focus.Collect(point.pulses.repartition(23), point.meta)
    assert np.allclose(once, dense(focus.backproject(spread, Grid(8, 8)), 8, 8), rtol=1e-9)


def test_refusals(point):
    with pytest.raises(ArgumentError):
        focus.full_aperture(point.meta, 700, 200)
    bad = focus.Collect(point.pulses, replace(point.meta, wavelength=0.0))
    with pytest.raises(MissingMetadata):
        focus.backproject(bad, GRID)
    with pytest.raises(ArgumentError):
        sub.from_pulses(point, GRID, SubapParams(mode="paper"))
    with pytest.raises(ArgumentError):
        sub.pulse_windows(10, 64, 0.4)


def test_pulse_windows_cover_each_pulse(spark):
    windows = sub.pulse_windows(1000, 16, 0.4)
    rows = spark.range(1000).select(
        F.col("id").alias("pulse"), sub.looks_of_pulse(windows, "id").alias("looks")
    ).collect()
    starts = windows.starts
    for r in rows:
        want = [i for i in range(16) if starts[i] <= r["pulse"] < starts[i] + windows.per]
        assert r["looks"] == want


def test_azimuth_resolution_uses_the_chord(point):
    chord = 7500.0 * 799 / 800
    want = point.meta.wavelength * 610327.78 / (2 * chord)
    assert focus.focus_azimuth_resolution(point, 800) == pytest.approx(want, rel=1e-4)


@pytest.fixture(scope="module")
def blob(spark):
    image, meta = simulate_image(spark, 128)
    return image.persist(), meta


def test_band_layouts():
    uniform = sub.band_layout(SubapParams(n_looks=4, overlap=0.5), 10.0, 2.0)
    assert uniform.width == pytest.approx(10.0 / 2.5)
    assert uniform.centres[0] == pytest.approx(-5 + 2.0)
    assert uniform.centres[-1] + uniform.width / 2 == pytest.approx(5.0)
    paper = sub.band_layout(SubapParams(mode="paper", n_looks=8), 16.0, 2.0)
    assert paper.width == 8.0 and paper.step == 1.0 and paper.dt == pytest.approx(2.0 / 16)
    # All N steps fit, so the last band ends one step short of the edge.
    assert paper.centres[-1] + paper.width / 2 + paper.step == pytest.approx(8.0)
    pair = SubapParams(mode="paper", n_looks=8, pair=True)
    assert sub.band_layout(pair, 16.0, 2.0).b_shift == 1.0
    with pytest.raises(ArgumentError):
        sub.band_layout(replace(pair, b_shift_hz=1.5), 16.0, 2.0)
    with pytest.raises(ArgumentError):
        sub.band_layout(SubapParams(pair=True), 16.0, 2.0)
    with pytest.raises(ArgumentError):
        sub.band_layout(SubapParams(mode="paper", left_out_frac=1.0), 16.0, 2.0)


def test_split_needs_enough_lines(blob):
    image, meta = blob
    with pytest.raises(ArgumentError):
        sub.split(image, meta, SubapParams(n_looks=100))
    with pytest.raises(MissingMetadata):
        sub.split(image, replace(meta, fs_az=0.0), SubapParams(n_looks=4))


def test_split_keeps_the_target_and_loses_resolution(blob):
    image, meta = blob
    stack = sub.split(image, meta, SubapParams(n_looks=4))
    look = np.abs(dense(stack.pixels.where(F.col("look") == 2), 128, 128))
    whole = np.abs(dense(image, 128, 128))
    assert look[:, 64].argmax() == pytest.approx(whole[:, 64].argmax(), abs=4)
    assert (look[:, 64] > 0.5 * look[:, 64].max()).sum() > (whole[:, 64] > 0.5 * whole[:, 64].max()).sum()


def test_default_pair_is_the_next_master(blob):
    image, meta = blob
    params = SubapParams(mode="paper", n_looks=4, pair=True, window=False)
    stack = sub.split(image, meta, params)
    slave = dense(stack.slave.where(F.col("look") == 0), 128, 128)
    master = dense(stack.pixels.where(F.col("look") == 1), 128, 128)
    assert np.abs(slave - master).max() < 1e-9
    assert stack.meta.pair_lag_s > 0


def bessel(order, x):
    from math import factorial

    return sum((-1) ** k / (factorial(k) * factorial(k + order)) * (x / 2) ** (2 * k + order) for k in range(20))


def test_vibration_makes_paired_echoes(spark):
    """A vibrating point has echoes where and as bright as modulation theory says."""
    f, amp = 2.0, 0.001
    collect = simulate(spark, [Target(0.0, 0.0, 0.0, 1.0, f, amp)])
    grid = Grid(161, 1, dx=0.05, dy=1.0)
    line = np.abs(dense(focus.backproject(collect, grid), 161, 1))[:, 0]
    slant = np.hypot(350000.0, 500000.0)
    away = f * collect.meta.wavelength * slant / (2 * 7500.0)
    beta = 4 * np.pi * amp * (500000.0 / slant) / collect.meta.wavelength
    x = (np.arange(161) - 80) * 0.05
    for side in (-1, 1):
        near = np.abs(x - side * away) < 0.3
        at = x[near][line[near].argmax()]
        assert at == pytest.approx(side * away, abs=0.06)
        ratio = line[near].max() / line[np.abs(x) < 0.1].max()
        # The echo's range walks a little against its cell's, which costs some brightness.
        assert ratio == pytest.approx(bessel(1, beta) / bessel(0, beta), rel=0.25)


def test_partial_images_merge_inside_a_partition(spark, point):
    """However small the batches, a partition hands on each cell of each of its looks once."""
    windows = sub.pulse_windows(point.meta.n_pulse, 4, 0.5)
    grid = Grid(8, 8)
    few = focus.Collect(point.pulses.coalesce(3), point.meta)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        parts = focus.partial_images(few, grid, windows)
        assert parts.count() <= 3 * 4 * 64
        small = dense(focus.backproject(few, grid, windows).where("look = 1").drop("look"), 8, 8)
    finally:
        spark.conf.set(key, before)
    whole = dense(focus.backproject(point, grid, windows).where("look = 1").drop("look"), 8, 8)
    assert np.allclose(small, whole, rtol=1e-9, atol=1e-9)


def test_looks_beyond_the_room_are_handed_on_early(spark, point, monkeypatch):
    windows = sub.pulse_windows(point.meta.n_pulse, 8, 0.0)
    whole = focus.backproject(point, Grid(8, 8), windows)
    want = {(r["look"], r["az"], r["rg"]): complex(r["re"], r["im"]) for r in whole.collect()}
    monkeypatch.setattr(focus, "ACCUMULATOR_BYTES", 1)
    got = focus.backproject(point, Grid(8, 8), windows)
    for r in got.collect():
        assert abs(complex(r["re"], r["im"]) - want[r["look"], r["az"], r["rg"]]) < 1e-6
