import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from sarmotion.errors import MissingMetadata
from sarmotion.functions import geodesy as geo
from sarmotion.functions import geometry as g
from sarmotion.operators import orbit
from sarmotion.operators.orbit import interpolate_orbit
from sarmotion.params import Plane


@pytest.mark.parametrize(
    "expression, expected, tolerance",
    [
        (lambda: g.acoustic_wavelength(6000, 12500), 0.24, 1e-9),
        (lambda: g.acoustic_wavelength(6600, 22000, "patent"), 0.30, 1e-9),
        (lambda: g.acoustic_wavelength(3500e3 / 3600, 200, "patent"), 4.861, 1e-3),
        (lambda: g.acoustic_wavelength(-1, 200), 0.0, 0),
        (lambda: g.orbital_aperture(7000, 12), 84000.0, 1e-6),
        (lambda: g.depth_resolution(0.24, 650000, 84000), 0.9286, 0.02),
        (lambda: g.depth_resolution(0.30, 650000, 75000), 1.30, 1e-9),
        (lambda: g.depth_resolution(0.30, 650000, 0), 0.0, 0),
        (lambda: g.vibration_fmax(16, 10), 0.8, 1e-12),
        (lambda: g.vibration_fmax(300, 10), 15.0, 1e-12),
        (lambda: g.vibration_fmax_overlap(1.0, 0.5), 1.0, 1e-12),
        (lambda: g.vibration_fmax_overlap(1.0, 1.0), 0.0, 0),
        (lambda: g.azimuth_resolution(0.031, 5e5, 7500, 10 / 16), 1.65, 0.05 * 1.65),
        (lambda: g.azimuth_resolution(0.031, 5e5, 7500, 10 / 300), 31.0, 0.05 * 31),
        (lambda: g.wavenumber(1000, 0.031, 5e5, 0.0), 0.0, 0),
        (lambda: g.subaperture_response(1.0, 1.0), 0.0, 1e-12),
        (lambda: g.subaperture_response(1.0, 0.0), 1.0, 0),
        (lambda: g.max_velocity(64, 1.0, 5e5, 7500), 0.48, 1e-12),
        (lambda: g.doppler_polynomial(F.array(*map(F.lit, [1.0, 2.0, 3.0])), 3.0, 1.0), 17.0, 1e-12),
        (lambda: g.doppler_polynomial(F.array().cast("array<double>"), 3.0, 1.0), 0.0, 0),
        (lambda: g.raised_cosine(0.0, 0.0, 4.0, 1.0), 1.0, 0),
        (lambda: g.raised_cosine(1.5, 0.0, 4.0, 1.0), 0.5, 1e-12),
        (lambda: g.raised_cosine(2.0, 0.0, 4.0, 1.0), 0.0, 0),
        (lambda: g.bin_frequency(0, 5, 10.0), -4.0, 1e-12),
        (lambda: g.wrap_phase(3 * math.pi + 0.25), -math.pi + 0.25, 1e-9),
    ],
)
def test_closed_forms(value, expression, expected, tolerance):
    assert value(expression()) == pytest.approx(expected, abs=max(tolerance, 1e-15))


def test_recommended_looks(value):
    assert value(g.recommend_looks(0.0, 0.01, 10, 0.03, 0.4)) == 0
    assert value(g.recommend_looks(1e-9, 1e-9, 1, 0.03, 0.0)) == 2
    need = 1 + ((4 * math.pi / 0.75) * 0.5 * 0.02 * 20 / 0.031 - 1) / 0.6
    assert value(g.recommend_looks(0.5, 0.02, 20, 0.031, 0.4)) == math.ceil(need)


def test_image_faults_name_the_first_field(value):
    good = [1000.0, 0.03, 1.0, 1.0, 0.5, 1000.0]
    assert value(g.image_faults(*good)) is None
    for i, bad, name in [(0, 0.1, "fs_az"), (1, 5.0, "wavelength"), (2, 1e4, "az_spacing"),
                         (3, 1e-5, "rg_spacing"), (4, 2.0, "incidence"), (5, 7000.0, "line_rate")]:
        assert value(g.image_faults(*[bad if j == i else v for j, v in enumerate(good)])) == name


ECF = (-120301.196, -4594117.3286, 4408300.01)
LLH = (44.0, -91.5, 300.0)


def test_known_point_both_ways(value):
    there = value(geo.ecf_to_llh(*ECF))
    assert there["lat"] == pytest.approx(LLH[0], abs=1e-9)
    assert there["lon"] == pytest.approx(LLH[1], abs=1e-9)
    assert there["hae"] == pytest.approx(LLH[2], abs=1e-3)
    back = value(geo.llh_to_ecf(*LLH))
    assert [back[c] for c in "xyz"] == pytest.approx(ECF, abs=1e-3)


def test_geodesy_refusals(value):
    assert value(geo.ecf_to_llh(0.0, 0.0, 0.0)) is None
    assert value(geo.llh_to_ecf(91.0, 0.0, 0.0)) is None
    with pytest.raises(MissingMetadata):
        geo.plane_point(None, 0.0, 0.0)


def test_plane_round_trip(value):
    plane = Plane(ECF, (1.0, 0.0, 0.0), (0.0, 0.6, 0.8))
    x, y = F.lit(120.0), F.lit(-45.0)
    at = geo.plane_llh(plane, x, y)
    back = value(geo.plane_offset(plane, at["lat"], at["lon"], at["hae"]))
    assert (back["x"], back["y"]) == pytest.approx((120.0, -45.0), abs=1e-6)


def test_projection_reaches_the_height(spark):
    point = geo.llh_to_ecf(F.lit(46.0), F.lit(-97.0), F.lit(0.0))
    sensor = geo.llh_to_ecf(F.lit(44.0), F.lit(-95.0), F.lit(600000.0))
    speed = F.struct(F.lit(3000.0).alias("x"), F.lit(-2000.0).alias("y"), F.lit(6500.0).alias("z"))
    row = spark.range(1).select(
        geo.project_to_height(sensor, point, F.lit(250.0)).alias("p"),
        geo.slant_to_ground(sensor, speed, point, F.lit(250.0)).alias("q"),
        geo.project_to_height(sensor, point, F.lit(9e9)).alias("never"),
        sensor.alias("s"), point.alias("t"),
    )
    found = row.select(
        geo.ecf_to_llh("p.x", "p.y", "p.z")["hae"].alias("hp"),
        geo.ecf_to_llh("q.x", "q.y", "q.z")["hae"].alias("hq"), "q", "s", "t", "never",
    ).first()
    assert found["hp"] == pytest.approx(250.0, abs=1e-3)
    assert found["hq"] == pytest.approx(250.0, abs=1e-3)
    reach = [math.dist(found[a], found["s"]) for a in ("q", "t")]
    assert reach[0] == pytest.approx(reach[1], abs=1e-3)  # the range is kept
    assert found["never"] is None or found["never"]["x"] is None or math.isnan(found["never"]["x"])


def test_crossings_are_sought_outwards():
    """The nearest of all crossings by a full scan, for rows with none, several and ties; near ones cost few steps."""
    rng = np.random.default_rng(5)
    waves, offset = rng.integers(1, 4, 50), np.r_[rng.uniform(-1.2, 1.2, 48), 0.0, 5.0]
    seen = []

    def above(phi, rows):
        seen.append(len(rows))
        return np.cos(waves[rows] * phi) - offset[rows]

    found = geo._nearest_crossing(above, np.arange(50), 50)
    edges = -np.pi + 2.0 * np.pi * np.arange(721) / 720
    whole = np.cos(np.outer(waves, edges)) - offset[:, None]
    away = np.where(whole[:, :-1] * whole[:, 1:] <= 0, np.abs(0.5 * (edges[:-1] + edges[1:])), np.inf)
    assert found.tolist() == np.where(np.isfinite(away.min(axis=1)), away.argmin(axis=1), -1).tolist()
    assert (found < 0).any() and sum(seen) < 50 * 721
    seen.clear()
    near = geo._nearest_crossing(lambda phi, rows: seen.append(len(rows)) or phi - 0.01, np.arange(50), 50)
    assert set(near) == {361} and sum(seen) <= 50 * 6


def test_orbit_is_exact_for_cubics(spark):
    states = [(t, [t**3, 2.0 * t, 1.0], [3.0 * t**2, 2.0, 0.0]) for t in map(float, range(6))]
    schema = "states array<struct<t:double,pos:array<double>,vel:array<double>>>, t double"
    rows = [(states, 2.5), (states, -1.0), (states[:1], 9.0), ([], 1.0)]
    found = interpolate_orbit(spark.createDataFrame(rows, schema), "states", "t").collect()
    assert found[0]["state"]["pos"] == pytest.approx([15.625, 5.0, 1.0])
    # Before the first vector the nearest four extrapolate.
    assert found[1]["state"]["pos"] == pytest.approx([-1.0, -2.0, 1.0])
    assert found[2]["state"]["pos"] == [0.0, 0.0, 1.0]
    assert found[3]["state"] is None


def test_asof_states_cross_many_ranges(spark, monkeypatch):
    """Ranges of a few rows, more of them with the tables: with no vectors, one or many, whatever lies between."""
    rng = np.random.default_rng(3)
    vectors = [(k, float(t), [float(t) ** 3, t * 2.0, 1.0], [float(t), 0.0, float(k or 9)])
               for k, times in ((0, range(0, 90, 2)), (1, [40]), (2, [10, 70]), (None, range(30, 40))) for t in times]
    asked = [(i, [0, 1, 2, 3, None][i % 5], float(x)) for i, x in enumerate(np.r_[rng.uniform(-10, 110, 150), np.full(40, 40.0)])]
    asked.append((900, 0, None))
    states = spark.createDataFrame(vectors, "k int, t double, pos array<double>, vel array<double>")
    requests = spark.createDataFrame(asked, "id int, k int, at double")
    plain = requests.join(
        states.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "pos", "vel"))).alias("all")).withColumnRenamed("k", "k2"),
        F.col("k").eqNullSafe(F.col("k2")), "left")
    near = {r["id"]: r["s"] for r in interpolate_orbit(
        plain.withColumn("all", F.coalesce("all", F.array().cast(plain.schema["all"].dataType))), "all", "at", "s").collect()}
    parts = []
    cut = orbit.cut_lineage
    monkeypatch.setattr(orbit, "cut_lineage", lambda df: parts.append(cut(df)) or parts[-1])
    for rows in (7, 40):
        monkeypatch.setattr(orbit, "RANGE_ROWS", rows)
        found = orbit.interpolate_orbit_asof(requests, states, "at", ["k"], "s").collect()
        assert len(found) == len(asked)
        for r in found:
            want = None if r["at"] is None else near[r["id"]]
            assert (r["s"] is None) == (want is None)
            if want:
                assert [r["s"]["t"], *r["s"]["pos"], *r["s"]["vel"]] == pytest.approx([want["t"], *want["pos"], *want["vel"]], rel=1e-9, abs=1e-6)
    sizes = [df.groupBy("_part").count().agg(F.max("count"), F.count("*")).first() for df in parts]
    assert sizes[0][0] < 40 and sizes[0][1] > sizes[1][1] > 3
