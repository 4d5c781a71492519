"""Looks, tracking, spectra and nulls on simulated scenes."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarmotion.errors import ArgumentError, MissingMetadata, RangeFault
from sarmotion.operators import nulls, selection
from sarmotion.operators import subaperture as sub
from sarmotion.operators.focus import Collect
from sarmotion.operators.spectrum import pack_series, spectrum, unpack_series
from sarmotion.operators.subaperture import ImageStack
from sarmotion.operators.tracking import track
from sarmotion.params import Grid, ImageMeta, MotionMeta, StackMeta, SubapParams, Target, TrackParams
from sarmotion.plans import commands
from scenes import simulate

PARAMS = TrackParams(
    win_az=24, win_rg=24, stride_az=8, stride_rg=8, upsample_az=40, upsample_rg=20, coherence_min=0.0
)


@pytest.fixture(scope="module")
def vibrating(spark):
    collect = simulate(spark, [Target(0.0, 0.0, 0.0, 1.0, 0.5, 0.020)])
    return Collect(collect.pulses.persist(), collect.meta)


@pytest.fixture(scope="module")
def stack(vibrating):
    built = sub.build(vibrating, Grid(48, 48), SubapParams(n_looks=64, overlap=0.4))
    return replace(built, pixels=built.pixels.persist())


def measured(stack, params, **kwargs):
    motion, meta = track(stack, params)
    return spectrum(pack_series(motion, meta.n_looks), meta, **kwargs), meta


def test_end_to_end_frequency(vibrating):
    found = commands.mmotion(
        vibrating, Grid(48, 48), SubapParams(n_looks=64, overlap=0.4), PARAMS, null_trials=2
    )
    assert abs(found.best["dominant_freq"] - 0.5) <= 3 * found.meta.df
    assert not found.refused and found.consensus["n_agree"] == 16
    assert found.consensus["n_contiguous"] == 16
    null = found.nulls["shuffle"]
    assert null["n_trials"] == 2 and null["mean"] < null["real"]


def test_exhaustive_search_agrees(stack):
    few = replace(stack, pixels=stack.pixels.where("look < 6"), meta=replace(stack.meta, n_looks=6))
    params = replace(PARAMS, upsample_az=8, upsample_rg=8, stride_az=24, stride_rg=24)
    local, _ = track(few, params)
    whole, _ = track(few, replace(params, exhaustive=True))
    a, b = (d.orderBy("win", "look").toPandas() for d in (local, whole))
    same = np.isclose(a["disp_az"], b["disp_az"]) & np.isclose(a["disp_rg"], b["disp_rg"])
    assert same.mean() > 0.8
    # Where they part, the wider search can only have found a higher peak.
    assert (b["quality"] >= a["quality"] - 1e-9).all()


@pytest.mark.parametrize("estimator, reference", [
    ("correlation", "first"), ("correlation", "adjacent"), ("correlation", "lag"), ("splitband", "first"),
    ("phase", "first"),
])
def test_physical_layout_does_not_change_series(stack, estimator, reference):
    few = replace(stack, pixels=stack.pixels.where("look < 9"), meta=replace(stack.meta, n_looks=9))
    params = replace(PARAMS, estimator=estimator, reference=reference, ref_lag=2, upsample_az=4, upsample_rg=4)
    runs = []
    for windows, looks in ((8, 32), (1, 3)):
        laid = replace(params, block_windows=windows, looks_per_task=looks)
        runs.append(track(few, laid)[0].orderBy("win", "look").toPandas())
    for column in ("disp_az", "disp_rg", "vel_los", "disp_los", "phase", "quality"):
        assert np.allclose(runs[0][column], runs[1][column], atol=1e-9), column


def test_adjacent_accumulates_and_lag_leads_with_zeros(stack):
    few = replace(stack, pixels=stack.pixels.where("look < 6"), meta=replace(stack.meta, n_looks=6))
    params = replace(PARAMS, stride_az=24, stride_rg=24, upsample_az=4, upsample_rg=4)
    lag1 = track(few, replace(params, reference="lag", ref_lag=1))[0].orderBy("win", "look").toPandas()
    adjacent = track(few, replace(params, reference="adjacent"))[0].orderBy("win", "look").toPandas()
    assert np.allclose(lag1.groupby("win")["disp_az"].cumsum(), adjacent["disp_az"])
    lag3 = track(few, replace(params, reference="lag", ref_lag=3))[0].toPandas()
    assert (lag3[lag3["look"] < 3]["disp_az"] == 0).all()


def test_mask_zeroes_but_keeps_quality(stack):
    few = replace(stack, pixels=stack.pixels.where("look < 4"), meta=replace(stack.meta, n_looks=4))
    masked = track(few, replace(PARAMS, coherence_min=1.1))[0].toPandas()
    assert (masked[["disp_az", "disp_rg", "vel_los", "disp_los"]] == 0).all().all()
    assert (masked["quality"] > 0).all()


def test_common_mode_is_the_median(stack):
    few = replace(stack, pixels=stack.pixels.where("look < 5"), meta=replace(stack.meta, n_looks=5))
    raw = track(few, PARAMS)[0].toPandas()
    clean = track(few, replace(PARAMS, remove_common_mode=True))[0].toPandas()
    want = raw["disp_az"] - raw.groupby("look")["disp_az"].transform("median")
    key = ["win", "look"]
    got = clean.sort_values(key)["disp_az"].to_numpy()
    assert np.allclose(got, want[raw.sort_values(key).index])


def test_tracking_refusals(stack):
    with pytest.raises(ArgumentError):
        track(replace(stack, meta=replace(stack.meta, n_looks=1)), PARAMS)
    with pytest.raises(ArgumentError):
        track(stack, replace(PARAMS, win_az=100))
    with pytest.raises(ArgumentError):
        track(stack, replace(PARAMS, reference="pair"))
    with pytest.raises(RangeFault):
        track(stack, replace(PARAMS, exhaustive=True, upsample_az=400, upsample_rg=400))
    paired = ImageStack(stack.pixels, stack.meta, stack.pixels)
    with pytest.raises(ArgumentError):
        track(paired, replace(PARAMS, reference="pair", estimator="phase"))


def test_swept_frequencies_are_followed(spark):
    """Reported against injected frequency: a slope near one, not one lucky point."""
    injected, reported = [0.3, 0.5, 0.7, 0.9], []
    for f in injected:
        collect = simulate(spark, [Target(0.0, 0.0, 0.0, 1.0, f, 0.020)])
        built = sub.build(collect, Grid(64, 64, 0.5, 0.5), SubapParams(n_looks=128, overlap=0.0))
        params = TrackParams(win_az=32, win_rg=32, stride_az=16, stride_rg=16, coherence_min=0.0)
        spectra, meta = measured(built, params)
        reported.append(selection.require_window(selection.best_window(spectra, meta), meta)["dominant_freq"])
    close = [abs(a - b) < 0.5 * meta.df + 1e-9 for a, b in zip(injected, reported)]
    assert sum(close) >= 3, reported
    good = [(a, b) for a, b, c in zip(injected, reported, close) if c]
    slope = np.polyfit(*zip(*good), 1)[0]
    assert abs(slope - 1) < 0.15


# -- spectra on made series ----------------------------------------------------------

META = MotionMeta(n_looks=64, dt=0.1, n_win_az=3, n_win_rg=3, quant_px=0.1)


def series(spark, rows):
    """rows: (win, quality, values)."""
    data = [
        (w, w // 3, w % 3, q, look, float(v), 0.0, float(v), float(v), 0.0)
        for w, q, values in rows for look, v in enumerate(values)
    ]
    schema = (
        "win bigint, iaz int, irg int, quality double, look bigint, disp_az double, disp_rg double, "
        "vel_los double, disp_los double, phase double"
    )
    return pack_series(spark.createDataFrame(data, schema), META.n_looks)


def tone(f, amp=1.0, n=64, dt=0.1):
    return amp * np.sin(2 * np.pi * f * np.arange(n) * dt + 0.3)


def test_density_matches_numpy(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=64) + 0.2 * np.arange(64)
    row = spectrum(series(spark, [(0, 1.0, y)]), META).first()
    i = np.arange(64)
    flat = y - np.polyval(np.polyfit(i, y, 1), i)
    taper = 0.5 * (1 - np.cos(2 * np.pi * i / 63))
    psd = np.abs(np.fft.rfft(flat * taper)) ** 2 * 2 * 0.1 / (taper**2).sum()
    psd[[0, -1]] /= 2
    assert np.allclose(row["psd"], psd)
    assert row["excursion_px"] == pytest.approx(np.ptp(y))


def test_tone_is_found_and_band_floor_applies(spark):
    y = tone(2.5) + 5 * tone(0.3125)
    loud = spectrum(series(spark, [(0, 1.0, y)]), META).first()
    assert loud["dominant_freq"] == pytest.approx(0.3125)
    above = spectrum(series(spark, [(0, 1.0, y)]), META, f_min=1.0).first()
    assert above["dominant_freq"] == pytest.approx(2.5)


def test_missing_looks_read_as_zero(spark):
    frame = spark.createDataFrame(
        [(0, 0, 0, 1.0, 5, 2.0)], "win bigint, iaz int, irg int, quality double, look bigint, v double"
    )
    packed = pack_series(frame, 8, columns=["v"]).first()
    assert packed["v"] == [0.0] * 5 + [2.0] + [0.0] * 2
    long = unpack_series(pack_series(frame, 8, columns=["v"]), columns=["v"])
    assert long.count() == 8


def test_spectrum_refusals(spark):
    made = series(spark, [(0, 1.0, tone(1.0))])
    with pytest.raises(ArgumentError):
        spectrum(made, replace(META, n_looks=3))
    with pytest.raises(MissingMetadata):
        spectrum(made, replace(META, dt=0.0))
    with pytest.raises(ArgumentError):
        spectrum(made, META, detrend="cubic")


def test_selection_and_consensus(spark):
    rows = [(w, 0.9, tone(2.5)) for w in (0, 1, 4)] + [(3, 0.9, tone(1.25)), (5, 0.9, tone(1.25))]
    rows += [(6, 0.3, tone(2.5)), (7, 0.9, tone(2.5, 0.01)), (8, 0.9, tone(0.625)), (2, 0.9, tone(3.75))]
    spectra = spectrum(series(spark, rows), META)
    best = selection.best_window(spectra, META).first()
    assert best["n_candidates"] == 7  # low quality and sub-quantum windows are out
    vote = selection.consensus(spectra, META).first()
    assert vote["consensus_freq"] == pytest.approx(2.5)
    assert (vote["n_agree"], vote["n_distinct"], vote["n_voting"]) == (3, 4, 7)
    marked = selection.agreeing(spectra, META).where("agrees")
    assert sorted(r["win"] for r in marked.collect()) == [0, 1, 4]
    assert selection.largest_block(marked).first()["n_contiguous"] == 3


def test_consensus_tie_takes_the_lower_frequency(spark):
    rows = [(0, 0.9, tone(2.5)), (1, 0.9, tone(2.5)), (2, 0.9, tone(1.25)), (3, 0.9, tone(1.25))]
    vote = selection.consensus(spectrum(series(spark, rows), META), META).first()
    assert vote["consensus_freq"] == pytest.approx(1.25)


def test_nothing_above_the_floor_is_refused(spark):
    spectra = spectrum(series(spark, [(0, 0.9, tone(2.5, 0.01))]), META)
    with pytest.raises(RangeFault):
        selection.require_window(selection.best_window(spectra, META), META)


def brute_blocks(cells):
    left, sizes = set(cells), []
    while left:
        stack, size = [left.pop()], 0
        while stack:
            a, r = stack.pop()
            size += 1
            for n in ((a + 1, r), (a - 1, r), (a, r + 1), (a, r - 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
        sizes.append(size)
    return sorted(sizes)


@pytest.mark.parametrize("density, tile", [(0.55, 3), (0.65, 4), (0.3, 64)])
def test_blocks_match_a_flood_fill(spark, density, tile):
    rng = np.random.default_rng(int(100 * density))
    cells = [(int(a), int(r)) for a, r in np.argwhere(rng.random((20, 20)) < density)]
    frame = spark.createDataFrame(cells, "iaz int, irg int")
    labelled = selection.connected_blocks(frame, tile=tile)
    sizes = sorted(r["count"] for r in labelled.groupBy("block").count().collect())
    assert sizes == brute_blocks(cells)


def test_long_snake_across_many_tiles(spark):
    cells = [(a, r) for a in range(0, 24, 2) for r in range(24)]
    cells += [(a + 1, 23 if (a // 2) % 2 == 0 else 0) for a in range(0, 22, 2)]
    frame = spark.createDataFrame(cells, "iaz int, irg int")
    assert selection.largest_block(frame, tile=4).first()["n_contiguous"] == len(cells)


def test_shuffles_are_permutations(spark):
    for seed in (1, 7, 99):
        assert sorted(nulls.permutation(32, seed)) == list(range(32))
    assert nulls.permutation(32, 1) != nulls.permutation(32, 2)
    rows = nulls.permutations(8, 3)
    for trial in range(3):
        assert sorted(r[2] for r in rows if r[0] == trial) == list(range(8))


def test_shuffle_moves_pairs_together(spark):
    pixels = spark.createDataFrame(
        [(k, 0, 0, float(k), 0.0) for k in range(8)], "look bigint, az int, rg int, re double, im double"
    )
    image = ImageMeta(n_az=1, n_rg=1)
    meta = StackMeta(8, image, 0.1, 5.0, 0.1, has_slave=True)
    moved = nulls.shuffle_once(ImageStack(pixels, meta, pixels.withColumn("im", F.lit(1.0))), 5)
    places = [{r["re"]: r["look"] for r in d.collect()} for d in (moved.pixels, moved.slave)]
    assert places[0] == places[1]
