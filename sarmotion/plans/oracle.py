"""The catalogue's queries in ANSI SQL, written independently of the operators."""

from __future__ import annotations

from ..operators.raster import PALETTES
from . import tables as t

PI = "pi()"


def _r(expr: str, name: str, digits: int = 6) -> str:
    unit = f"1e{digits}::DOUBLE"
    return f"floor(({expr})::DOUBLE * {unit} + 0.5) / {unit} AS {name}"


# -- geometry rows -----------------------------------------------------------------

GEOMETRY = """
geo AS (
  SELECT l_orderkey, l_linenumber,
    100.0::DOUBLE + 10.0::DOUBLE * sqrt(l_extendedprice) AS v,
    l_quantity * 10.0::DOUBLE - 20.0::DOUBLE AS f,
    400000.0::DOUBLE + 1500.0::DOUBLE * sqrt(l_extendedprice) AS slant,
    0.2::DOUBLE + l_discount * 5.0::DOUBLE AS theta,
    1.0::DOUBLE + l_quantity AS dwell, l_tax * 10.0::DOUBLE AS overlap
  FROM lineitem),
wave AS (
  SELECT *, CASE WHEN v > 0 AND f > 0 THEN v / (2.0 * f) ELSE 0.0 END AS lam,
    CASE WHEN v > 0 AND dwell > 0 THEN v * dwell ELSE 0.0 END AS aperture
  FROM geo)
"""

ACOUSTIC = f"""
WITH {GEOMETRY}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_r("lam", "paper")},
  {_r("CASE WHEN v > 0 AND f > 0 THEN v / (1.0 * f) ELSE 0.0 END", "patent")}
FROM wave
"""

RESOLUTION = f"""
WITH {GEOMETRY}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  {_r("aperture", "aperture", 3)},
  {_r("CASE WHEN aperture > 0 THEN lam * slant / (2.0 * aperture) ELSE 0.0 END", "depth_res", 3)},
  {_r("CASE WHEN v * dwell > 0 THEN 0.031 * slant / (2.0 * v * dwell) ELSE 0.0 END", "az_res")},
  {_r("CASE WHEN l_linenumber > 0 AND dwell > 0 THEN l_linenumber / (2.0 * dwell) ELSE 0.0 END", "fmax")},
  {_r("CASE WHEN dwell > 0 AND overlap >= 0 AND overlap < 1 THEN 1.0 / (2.0 * dwell * (1.0 - overlap)) ELSE 0.0 END", "fmax_overlap")},
  {_r("CASE WHEN f > 0 THEN dwell / f ELSE 0.0 END", "obs_ratio")},
  {_r("CASE WHEN f > 0 THEN dwell * f ELSE 0.0 END", "eta")},
  {_r(f"CASE WHEN theta > 0 AND f > 0 THEN abs(sin({PI} * f * theta) / ({PI} * f * theta)) ELSE 1.0 END", "response")},
  {_r("CASE WHEN overlap > 0 AND slant > 0 AND v > 0 THEN 0.5 * 64 * overlap * v / slant ELSE 0.0 END", "v_max")},
  CASE WHEN NOT (f > 0 AND dwell > 0 AND overlap >= 0 AND overlap < 1) THEN 0
       WHEN 1.0 + ((4.0 * {PI} / 0.75) * f * 0.002 * dwell / 0.031 - 1.0) / (1.0 - overlap) > 1
       THEN ceil(1.0 + ((4.0 * {PI} / 0.75) * f * 0.002 * dwell / 0.031 - 1.0) / (1.0 - overlap))::BIGINT
       ELSE 2 END::BIGINT AS looks
FROM wave
"""

WAVENUMBER = f"""
WITH {GEOMETRY},
k AS (SELECT l_orderkey, l_linenumber, CASE WHEN lam * slant * sin(theta) <> 0
  THEN 4.0 * {PI} * 75000.0 / (lam * slant * sin(theta)) ELSE 0.0 END AS kz FROM wave)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_r("kz", "kz", 5)},
  {_r(f"CASE WHEN kz > 0 THEN 2.0 * {PI} * 64.0 / kz ELSE 0.0 END", "max_depth", 4)}
FROM k
"""

DEPTH_SCALES = f"""
WITH {GEOMETRY},
s AS (SELECT *, CASE WHEN overlap - 0.3::DOUBLE > 0 THEN 2.0 * {PI} * (overlap - 0.3::DOUBLE) ELSE 1.0 END AS scale FROM wave)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_r("scale", "scale")}, {_r("lam * slant / 150000.0 / scale", "resolution")} FROM s
"""

# Eigenvalues of the 3 x 3 Gram matrix in closed form.
CONDITIONING = f"""
WITH {GEOMETRY},
k AS (SELECT l_orderkey, l_linenumber, CASE WHEN lam * slant * sin(theta) <> 0
  THEN 4.0 * {PI} * 75000.0 / (lam * slant * sin(theta)) ELSE 0.0 END AS kz FROM wave),
gm AS (SELECT kz, sum(cos(kz * i / 8.0::DOUBLE)) AS r1, sum(sin(kz * i / 8.0::DOUBLE)) AS i1,
    sum(cos(kz * i / 4.0::DOUBLE)) AS r2, sum(sin(kz * i / 4.0::DOUBLE)) AS i2 FROM (SELECT DISTINCT kz FROM k), range(16) r(i) GROUP BY kz),
p AS (SELECT *, sqrt((2 * (r1 * r1 + i1 * i1) + r2 * r2 + i2 * i2) / 3.0) AS p FROM gm),
a AS (SELECT *, acos(greatest(-1.0, least(1.0, ((r1 * r1 - i1 * i1) * r2 + 2 * r1 * i1 * i2) / (p * p * p)))) / 3.0 AS phi FROM p),
e AS (SELECT *, 16.0 + 2 * p * cos(phi) AS hi, 16.0 + 2 * p * cos(phi + 2 * {PI} / 3.0) AS lo FROM a),
sv AS (SELECT *, sqrt(hi) AS s1, sqrt(greatest(48.0 - hi - lo, 0.0)) AS s2, sqrt(greatest(lo, 0.0)) AS s3 FROM e)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 1 + (s2 > 0.001 * s1)::BIGINT + (s3 > 0.001 * s1)::BIGINT AS rank,
  {_r("s1", "sv_max", 4)}, {_r("s3", "sv_min", 4)} FROM k JOIN sv USING (kz)
"""

FEASIBILITY = f"""
WITH a AS (SELECT o_orderkey, 1.0::DOUBLE + sqrt(o_totalprice) / 40.0::DOUBLE AS dwell,
    unnest([8, 16, 32, 64, 128, 300]) AS n_looks FROM orders)
SELECT o_orderkey, n_looks::BIGINT AS n_looks, {_r("dwell / n_looks", "dt")},
  {_r("n_looks / (2.0 * dwell)", "f_max")},
  {_r("0.0305::DOUBLE * 640000.0 / (2.0 * 7410.0 * (dwell / n_looks))", "az_resolution")}
FROM a
"""

BAND = f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 1000.0::DOUBLE AS p,
    abs(l_quantity - 25.0) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  {_r(f"CASE WHEN d <= 7.5 THEN 1.0 WHEN d >= 15.0 THEN 0.0 ELSE 0.5 * (1.0 + cos({PI} * (d - 7.5) / 7.5)) END", "gain")},
  {_r("(q - 25) * 100.0::DOUBLE / 51.0::DOUBLE", "freq")},
  {_r(f"p - 2.0 * {PI} * ceil((p - {PI}) / (2.0 * {PI}))", "wrapped")}
FROM b
"""

POLYNOMIAL = f"""
WITH c AS (SELECT vec_id, b AS block, [x::DOUBLE FOR x IN embedding[b * 8 + 1 : b * 8 + 8]] AS e,
    label / 5.0::DOUBLE - 1.5::DOUBLE AS d FROM embeddings, range(8) r(b))
SELECT vec_id, block, {_r("e[1] + d * (e[2] + d * (e[3] + d * (e[4] + d * (e[5] + d * (e[6] + d * (e[7] + d * e[8]))))))", "doppler_hz")}
FROM c
"""

ORBIT = f"""
WITH v AS (SELECT vec_id, label * 0.93::DOUBLE - 0.4::DOUBLE AS t, embedding AS e FROM embeddings),
sv AS (SELECT vec_id, t, i, i + 0.05::DOUBLE * tanh(e[i * 8 + 7]::DOUBLE) + 0.05::DOUBLE * tanh(e[i * 8 + 8]::DOUBLE) AS s,
    e[i * 8 + 1]::DOUBLE AS x0, e[i * 8 + 2]::DOUBLE AS x1, e[i * 8 + 3]::DOUBLE AS x2,
    e[i * 8 + 4]::DOUBLE AS y0, e[i * 8 + 5]::DOUBLE AS y1, e[i * 8 + 6]::DOUBLE AS y2
  FROM v, range(8) r(i)),
place AS (SELECT vec_id, least(greatest(least(count(*) FILTER (WHERE i < 7 AND s <= t), 7) - 1, 0), 6) AS lo
  FROM sv GROUP BY vec_id),
near AS (SELECT sv.* FROM sv JOIN place USING (vec_id) WHERE i >= lo AND i < lo + 4),
w AS (SELECT a.vec_id, a.i, product((a.t - b.s) / (a.s - b.s)) AS w
  FROM near a JOIN near b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY ALL)
SELECT vec_id, {_r("any_value(t)", "t")},
  {", ".join(_r(f"sum(w * x{k})", f"p{k}") for k in range(3))},
  {", ".join(_r(f"sum(w * y{k})", f"v{k}") for k in range(3))}
FROM near JOIN w USING (vec_id, i) GROUP BY vec_id
"""

_STATE_AXES = {
    "p0": "price", "p1": "customer", "p2": "price * customer", "v0": "customer", "v1": "price", "v2": "price - customer"}
ORBIT_ASOF = f"""
WITH o AS (SELECT o_custkey % 3 AS platform, o_orderkey * 173.0::DOUBLE AS t, o_totalprice / 100000.0::DOUBLE AS price, o_custkey / 100.0::DOUBLE AS customer FROM orders),
s AS (SELECT platform, t, {", ".join(f"{e} AS {n}" for n, e in _STATE_AXES.items())},
    row_number() OVER (PARTITION BY platform ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY platform) AS n FROM o),
q AS (SELECT event_id, user_id % 3 AS platform, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS t FROM events),
lo AS (SELECT q.*, greatest(least(coalesce(s.i, 0), s.n - 2), 0) AS lo FROM q ASOF LEFT JOIN s ON q.platform = s.platform AND q.t >= s.t),
near AS (SELECT lo.event_id, lo.platform, lo.t, s.t AS s, s.i, {", ".join(f"s.{n}" for n in _STATE_AXES)} FROM lo
  JOIN s ON s.platform = lo.platform AND s.i >= lo.lo AND s.i < lo.lo + 4),
w AS (SELECT a.event_id, a.i, product((a.t - b.s) / (a.s - b.s)) AS w FROM near a JOIN near b ON a.event_id = b.event_id AND a.i <> b.i GROUP BY ALL)
SELECT event_id, any_value(platform) AS platform, {_r("any_value(t)", "t", 3)}, {", ".join(_r(f"sum(w * {n})", n, 4) for n in _STATE_AXES)}
FROM near JOIN w USING (event_id, i) GROUP BY event_id
"""

FAULTS = """
WITH i AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 1.02::DOUBLE AS fs, l_discount * 12.0::DOUBLE AS lam,
    l_quantity - 2.0 AS az, l_tax * 20.0::DOUBLE AS inc, l_extendedprice * 20.0::DOUBLE AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE
  WHEN NOT (fs >= 1.0 AND fs <= 100000.0) THEN 'fs_az'
  WHEN NOT (lam >= 0.001 AND lam <= 1.0) THEN 'wavelength'
  WHEN az <> 0 AND NOT (abs(az) >= 0.01 AND abs(az) <= 1000.0) THEN 'az_spacing'
  WHEN inc <> 0 AND NOT (inc > 0 AND inc < pi() / 2) THEN 'incidence'
  WHEN v > 0 AND az > 0 AND fs > 0 AND (v / az / fs > 1.5 OR v / az / fs < 1.0::DOUBLE / 1.5) THEN 'line_rate'
  ELSE 'ok' END AS fault
FROM i
"""

# -- geodesy -------------------------------------------------------------------------

A, INV_F = "6378137.0::DOUBLE", "298.257223563::DOUBLE"
ELLIPSOID = f"""
ell AS (SELECT {A} AS a, {A} * (1 - 1 / {INV_F}) AS b, (1 / {INV_F}) * (2 - 1 / {INV_F}) AS e2),
wgs AS (SELECT a, b, e2, (a * a - b * b) / (b * b) AS ep2 FROM ell)
"""
PLACES = """
places AS (SELECT c_custkey AS key, ((c_custkey * 37) % 179 - 89)::DOUBLE AS lat,
    ((c_custkey * 73) % 359 - 179)::DOUBLE AS lon, c_acctbal AS hae FROM customer)
"""


def _to_ecf(source: str, lat: str, lon: str, hae: str, out: str, keep: str = "key") -> str:
    return f"""
{out}_n AS (SELECT {source}.*, a / sqrt(1 - e2 * sin(radians({lat})) ** 2) AS pn, e2 FROM {source}, wgs),
{out} AS (SELECT {keep}, (pn + {hae}) * cos(radians({lat})) * cos(radians({lon})) AS x,
    (pn + {hae}) * cos(radians({lat})) * sin(radians({lon})) AS y,
    (pn * (1 - e2) + {hae}) * sin(radians({lat})) AS z FROM {out}_n)
"""


def _to_llh(source: str, out: str, keep: str = "key, x, y, z") -> str:
    return f"""
{out}_t AS (SELECT {keep}, sqrt(x * x + y * y) AS p, atan2(z * a, sqrt(x * x + y * y) * b) AS th, a, b, e2, ep2
  FROM {source}, wgs),
{out}_l AS (SELECT *, atan2(z + ep2 * b * sin(th) ** 3, p - e2 * a * cos(th) ** 3) AS phi FROM {out}_t),
{out} AS (SELECT {keep}, degrees(phi) AS lat, degrees(atan2(y, x)) AS lon,
    CASE WHEN abs(cos(phi)) > 1e-9 THEN p / cos(phi) - a / sqrt(1 - e2 * sin(phi) ** 2)
         ELSE abs(z) - b END AS hae FROM {out}_l)
"""


ROUNDTRIP = f"""
WITH {ELLIPSOID}, {PLACES}, {_to_ecf("places", "lat", "lon", "hae", "ecf")}, {_to_llh("ecf", "back")}
SELECT key, {_r("x", "x", 3)}, {_r("y", "y", 3)}, {_r("z", "z", 3)},
  {_r("lat", "lat")}, {_r("lon", "lon")}, {_r("hae", "hae", 3)} FROM back
"""

ORIGIN = ("-120301.196::DOUBLE", "-4594117.3286::DOUBLE", "4408300.01::DOUBLE")
UX = ("0.9996573::DOUBLE", "-0.0261769::DOUBLE", "0.0::DOUBLE")
UY = ("0.018184::DOUBLE", "0.6944203::DOUBLE", "0.7193398::DOUBLE")


def _dot(axis: tuple[str, ...]) -> str:
    return " + ".join(f"({c} - ({o})) * ({u})" for c, o, u in zip("xyz", ORIGIN, axis))


def _plane_xyz(px: str, py: str) -> str:
    return ", ".join(
        f"({o}) + {px} * ({u}) + {py} * ({w}) AS {c}" for c, o, u, w in zip("xyz", ORIGIN, UX, UY)
    )


SCENE_PLACES = f"""
WITH {ELLIPSOID}, {PLACES}, {_to_ecf("places", "lat", "lon", "hae", "ecf")},
spot AS (SELECT * FROM (VALUES ('first', 0.0, 0.0), ('last_range', 0.0, 750.0), ('last', 1000.0, 750.0), ('last_azimuth', 1000.0, 0.0),
  ('centre', 500.0, 375.0)) v(place, a, r)),
pt AS (SELECT key, place, {", ".join(f"{c} + a * ({u}) + r * ({w}) AS {c}" for c, u, w in zip("xyz", UX, UY))} FROM ecf, spot),
{_to_llh("pt", "back", "key, place, x, y, z")}
SELECT key, place, {_r("lat", "lat")}, {_r("lon", "lon")}, {_r("hae", "hae", 3)} FROM back
"""
PLANE = f"""
WITH {ELLIPSOID}, {PLACES},
near AS (SELECT key, 44.0::DOUBLE + lat / 100.0 AS lat, -91.5::DOUBLE + lon / 100.0 AS lon, hae FROM places),
{_to_ecf("near", "lat", "lon", "hae", "ecf")},
off AS (SELECT key, {_dot(UX)} AS px, {_dot(UY)} AS py FROM ecf),
pt AS (SELECT key, px, py, {_plane_xyz("px", "py")} FROM off),
{_to_llh("pt", "back", "key, px, py, x, y, z")}
SELECT key, {_r("px", "x", 3)}, {_r("py", "y", 3)}, {_r("lat", "lat")}, {_r("lon", "lon")},
  {_r("hae", "hae", 3)} FROM back
"""


def _inline_height(x: str, y: str, z: str) -> str:
    """Ellipsoidal height as one scalar expression over the columns wa, wb, we, wep."""
    p = f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    th = f"atan2(({z}) * wa, {p} * wb)"
    phi = f"atan2(({z}) + wep * wb * sin({th}) ** 3, {p} - we * wa * cos({th}) ** 3)"
    return f"({p} / cos({phi}) - wa / sqrt(1 - we * sin({phi}) ** 2))"


RAYS = f"""
{ELLIPSOID}, {PLACES},
ray_in AS (SELECT key, lat, lon, 0.0::DOUBLE AS h0, lat * 0.97::DOUBLE AS slat, lon * 0.97::DOUBLE AS slon,
    600000.0::DOUBLE AS h1, hae / 10.0::DOUBLE AS target FROM places),
{_to_ecf("ray_in", "lat", "lon", "h0", "ground")},
{_to_ecf("ray_in", "slat", "slon", "h1", "craft")},
ray AS (SELECT r.key, g.x AS gx, g.y AS gy, g.z AS gz, s.x AS sx, s.y AS sy, s.z AS sz, r.target,
    wgs.a AS wa, wgs.b AS wb, wgs.e2 AS we, wgs.ep2 AS wep
  FROM ray_in r JOIN ground g USING (key) JOIN craft s USING (key), wgs)
"""

PROJECT = f"""
WITH RECURSIVE {RAYS},
unit AS (SELECT *, sqrt((gx - sx) ** 2 + (gy - sy) ** 2 + (gz - sz) ** 2) AS norm FROM ray),
dir AS (SELECT *, (gx - sx) / norm AS dx, (gy - sy) / norm AS dy, (gz - sz) / norm AS dz FROM unit),
bis AS (
  SELECT *, 0.0::DOUBLE AS lo, 2.0 * norm AS hi, 0 AS it FROM dir
  UNION ALL
  SELECT * EXCLUDE (lo, hi, it, mid, hm, hl),
    CASE WHEN (hl - target) * (hm - target) <= 0 THEN lo ELSE mid END AS lo,
    CASE WHEN (hl - target) * (hm - target) <= 0 THEN mid ELSE hi END AS hi, it + 1 AS it
  FROM (SELECT *, {_inline_height("sx + mid * dx", "sy + mid * dy", "sz + mid * dz")} AS hm,
      {_inline_height("sx + lo * dx", "sy + lo * dy", "sz + lo * dz")} AS hl
    FROM (SELECT *, 0.5 * (lo + hi) AS mid FROM bis WHERE it < 60)))
SELECT key, {", ".join(_r(f"CASE WHEN ok THEN s{c} + 0.5 * (lo + hi) * d{c} END", c, 2) for c in "xyz")}
FROM (SELECT *, ({_inline_height("sx", "sy", "sz")} - target)
    * ({_inline_height("sx + 2.0 * norm * dx", "sy + 2.0 * norm * dy", "sz + 2.0 * norm * dz")} - target) <= 0 AS ok
  FROM bis WHERE it = 60)
"""

_ARM = {c: f"c{c} + rad * (cos(PHI) * e1{c} + sin(PHI) * e2{c})" for c in "xyz"}


def _circle(phi: str) -> list[str]:
    return [_ARM[c].replace("PHI", phi) for c in "xyz"]


SLANT = f"""
WITH RECURSIVE {RAYS},
vel AS (SELECT 3000.0::DOUBLE AS vx, -2000.0::DOUBLE AS vy, 6500.0::DOUBLE AS vz),
u AS (SELECT *, vx / sqrt(vx * vx + vy * vy + vz * vz) AS ux, vy / sqrt(vx * vx + vy * vy + vz * vz) AS uy,
    vz / sqrt(vx * vx + vy * vy + vz * vz) AS uz FROM ray, vel),
al AS (SELECT *, (gx - sx) * ux + (gy - sy) * uy + (gz - sz) * uz AS along FROM u),
rd AS (SELECT *, sx + along * ux AS cx, sy + along * uy AS cy, sz + along * uz AS cz,
    gx - sx - along * ux AS rx, gy - sy - along * uy AS ry, gz - sz - along * uz AS rz FROM al),
e1 AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS rad FROM rd),
e2 AS (SELECT *, rx / rad AS e1x, ry / rad AS e1y, rz / rad AS e1z FROM e1),
cir AS (SELECT *, uy * e1z - uz * e1y AS e2x, uz * e1x - ux * e1z AS e2y, ux * e1y - uy * e1x AS e2z FROM e2),
scan AS (SELECT key, k, {_inline_height(*_circle(f"(-{PI} + 2.0 * {PI} * k / 720.0::DOUBLE)"))} - target AS h
  FROM cir, range(721) s(k)),
cross_at AS (SELECT key, k, abs(0.5 * ((-{PI} + 2.0 * {PI} * (k - 1) / 720.0::DOUBLE) + (-{PI} + 2.0 * {PI} * k / 720.0::DOUBLE))) AS away
  FROM (SELECT *, lag(h) OVER (PARTITION BY key ORDER BY k) AS h0 FROM scan) WHERE h0 * h <= 0),
best AS (SELECT key, k FROM cross_at QUALIFY row_number() OVER (PARTITION BY key ORDER BY away, k) = 1),
bis AS (
  SELECT cir.*, -{PI} + 2.0 * {PI} * (k - 1) / 720.0::DOUBLE AS lo, -{PI} + 2.0 * {PI} * k / 720.0::DOUBLE AS hi, 0 AS it
  FROM cir JOIN best USING (key)
  UNION ALL
  SELECT * EXCLUDE (lo, hi, it, mid, hm, hl),
    CASE WHEN (hl - target) * (hm - target) <= 0 THEN lo ELSE mid END AS lo,
    CASE WHEN (hl - target) * (hm - target) <= 0 THEN mid ELSE hi END AS hi, it + 1 AS it
  FROM (SELECT *, {_inline_height(*_circle("mid"))} AS hm, {_inline_height(*_circle("lo"))} AS hl
    FROM (SELECT *, 0.5 * (lo + hi) AS mid FROM bis WHERE it < 60)))
SELECT p.key, {", ".join(_r(e.replace("mid", "(0.5 * (lo + hi))"), c, 2) for c, e in zip("xyz", _circle("mid")))}
FROM places p LEFT JOIN (SELECT * FROM bis WHERE it = 60) b USING (key)
"""

# -- Doppler -------------------------------------------------------------------------

LINES = """
px AS (SELECT vec_id AS rg, label, i AS az, embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im
  FROM embeddings, range(32) r(i)),
ft AS (SELECT rg, label, k, sum(re * cos(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE) + im * sin(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE)) AS fr,
    sum(im * cos(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE) - re * sin(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE)) AS fi
  FROM px, range(32) s(k) GROUP BY rg, label, k)
"""
POWER = f"{LINES}, pw AS (SELECT label, k, avg(fr * fr + fi * fi) AS power FROM ft GROUP BY label, k)"

AZIMUTH_POWER = f"WITH {POWER} SELECT label::BIGINT AS label, k::BIGINT AS k, {_r('power', 'power')} FROM pw"

CENTROID = f"""
WITH {POWER}
SELECT label::BIGINT AS label, {_r("sum((k - 16) * power) / sum(power)", "centroid_hz")} FROM pw GROUP BY label
"""

BANDWIDTH = f"""
WITH {POWER},
pk AS (SELECT *, first_value(k) OVER (PARTITION BY label ORDER BY power DESC, k) AS pk,
    max(power) OVER (PARTITION BY label) * 0.5 AS lv FROM pw)
SELECT label::BIGINT AS label,
  {_r("(coalesce(min(k) FILTER (WHERE k > pk AND power <= lv), 31) - coalesce(max(k) FILTER (WHERE k < pk AND power <= lv), 0))::DOUBLE", "bandwidth_hz")}
FROM pk GROUP BY label
"""

SPREAD = f"""
{LINES},
pw AS (SELECT k, avg(fr * fr + fi * fi) AS power FROM ft GROUP BY k),
pk AS (SELECT *, first_value(k) OVER (ORDER BY power DESC, k) AS pk, max(power) OVER () * 0.5 AS lv FROM pw),
sp AS (SELECT sum((k - 16) * power) / sum(power) AS fdc,
    (coalesce(min(k) FILTER (WHERE k > pk AND power <= lv), 31) - coalesce(max(k) FILTER (WHERE k < pk AND power <= lv), 0))::DOUBLE AS bw
  FROM pk)
"""
INVERSE = """
im AS (SELECT {keep}, az, rg, sum(gr * cos(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE) - gi * sin(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE)) / 32 AS re,
    sum(gr * sin(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE) + gi * cos(2 * pi() * ((k + 16) % 32) * az / 32.0::DOUBLE)) / 32 AS im
  FROM banded, range(32) a(az) GROUP BY {keep}, az, rg)
"""

SPLIT = f"""
WITH {SPREAD},
lay AS (SELECT i AS look, fdc, bw / (4 - 3 * 0.4) AS w, -0.5 * bw + 0.5 * bw / (4 - 3 * 0.4) + i * bw / (4 - 3 * 0.4) * 0.6 AS c FROM sp, range(4) n(i)),
gain AS (SELECT look, k, CASE WHEN abs(k - 16 - fdc - c) <= 0.25 * w THEN 1.0 WHEN abs(k - 16 - fdc - c) >= 0.5 * w THEN 0.0
    ELSE 0.5 * (1 + cos({PI} * (abs(k - 16 - fdc - c) - 0.25 * w) / (0.25 * w))) END AS g FROM lay, range(32) s(k)),
banded AS (SELECT look, rg, k, fr * g AS gr, fi * g AS gi FROM ft JOIN gain USING (k)),
{INVERSE.format(keep="look")}
SELECT look, az::BIGINT AS az, rg::BIGINT AS rg, {_r("re", "re")}, {_r("im", "im")} FROM im
"""

PAIRED = f"""
WITH {SPREAD},
lay AS (SELECT i AS look, fdc, bw * 0.5 AS w, -0.5 * bw + 0.25 * bw + i * bw * 0.125 AS c0, bw * 0.125 AS sh FROM sp, range(4) n(i)),
roles AS (SELECT look, fdc, w, c0 AS c, 'master' AS role FROM lay UNION ALL SELECT look, fdc, w, c0 + sh, 'slave' FROM lay),
gain AS (SELECT look, role, k, CASE WHEN abs(k - 16 - fdc - c) <= 0.5 * w THEN 1.0 ELSE 0.0 END AS g FROM roles, range(32) s(k)),
banded AS (SELECT look, role, rg, k, fr * g AS gr, fi * g AS gi FROM ft JOIN gain USING (k)),
{INVERSE.format(keep="look, role")}
SELECT look, az::BIGINT AS az, rg::BIGINT AS rg, {_r("re", "re")}, {_r("im", "im")}, role FROM im
"""


def _layout(n: str, looks: int) -> str:
    """per, step and start of each of ``looks`` windows at 0.4 overlap."""
    return f"""
np AS (SELECT {n} AS n),
per AS (SELECT n, floor(n / (1.0::DOUBLE + {looks - 1} * (1.0::DOUBLE - 0.4::DOUBLE)))::BIGINT AS per FROM np),
stp AS (SELECT n, per, floor(per * (1.0::DOUBLE - 0.4::DOUBLE))::BIGINT AS step FROM per),
win AS (SELECT i AS look, per, least(i * step, n - per) AS start FROM stp, range({looks}) r(i))
"""


SLIDING = f"""
WITH {_layout("(SELECT count(*) FROM events)", 16)}
SELECT look::BIGINT AS look, count(*) AS n_pulses, min(event_id) AS first_pulse, max(event_id) AS last_pulse,
  {_r("avg(value)", "mean_value")}
FROM win JOIN events ON event_id >= start AND event_id < start + per GROUP BY look
"""

PULSES_OF = """
LAYOUT,
pos AS (SELECT vec_id AS pulse, embedding AS e, vec_id / 100.0::DOUBLE AS t,
    75.0::DOUBLE * (vec_id / 100.0::DOUBLE - (SELECT n FROM np) / 100.0::DOUBLE / 2.0) AS px FROM embeddings),
pl AS (SELECT *, sqrt(px * px + 3500.0::DOUBLE ** 2 + 5000.0::DOUBLE ** 2) AS r_ref FROM pos)
"""
def _pulses(looks: int) -> str:
    return PULSES_OF.replace("LAYOUT", _layout("(SELECT count(*) FROM embeddings)", looks))


def _looking(looks: int, columns: int) -> str:
    return f"""
{_pulses(looks)},
cell AS (SELECT a.i AS az, b.i AS rg, a.i - 3.5::DOUBLE AS gx, b.i - {(columns - 1) / 2}::DOUBLE AS gy FROM range(8) a(i), range({columns}) b(i)),
d AS (SELECT pulse, e, az, rg, r_ref, sqrt((px - gx) ** 2 + (3500.0 - gy) ** 2 + 5000.0::DOUBLE ** 2) - r_ref AS lagm FROM pl, cell),
f AS (SELECT *, lagm + 16.0 AS fbin, floor(lagm + 16.0)::INT AS b, lagm + 16.0 - floor(lagm + 16.0) AS fr,
    4 * {PI} / 0.03125::DOUBLE * lagm AS ph FROM d WHERE lagm + 16.0 >= 0 AND lagm + 16.0 < 31)
"""


PULSES = _pulses(4)
LOOKING = _looking(4, 8)


def _focus(extra: str, re: str, im: str) -> str:
    return f"""
WITH {LOOKING},
{extra}
s AS (SELECT pulse, az, rg, ph, {re} AS sr, {im} AS si FROM g)
SELECT look::BIGINT AS look, az::BIGINT AS az, rg::BIGINT AS rg,
  {_r("sum(sr * cos(ph) - si * sin(ph))", "re")}, {_r("sum(sr * sin(ph) + si * cos(ph))", "im")}
FROM s JOIN win ON pulse >= start AND pulse < start + per GROUP BY look, az, rg
"""


def _lerp(offset: int) -> str:
    return f"e[2 * b + {offset}]::DOUBLE * (1 - fr) + e[2 * b + {offset + 2}]::DOUBLE * fr"


BACKPROJECT = _focus("g AS (SELECT * FROM f),", _lerp(1), _lerp(2))


def _sinc(offset: int) -> str:
    terms = []
    for tap in range(-3, 5):
        x = f"(q - ({tap}))"
        w = f"(CASE WHEN abs{x} < 1e-12 THEN 1.0 ELSE sin({PI} * {x}) / ({PI} * {x}) * 0.5 * (1 + cos({PI} * {x} / 4.0)) END)"
        terms.append(f"{w} * e[2 * (b + ({tap})) + {offset}]::DOUBLE")
    return f"CASE WHEN b < 4 OR b + 4 >= 32 THEN {_lerp(offset)} ELSE {' + '.join(terms)} END"


BACKPROJECT_SINC = _focus(
    "g AS (SELECT *, floor(fr * 2048 + 0.5) / 2048.0::DOUBLE AS q FROM f),", _sinc(1), _sinc(2)
)

WINDOW_GEOMETRY = f"""
WITH {PULSES},
edge AS (SELECT look, f.t AS t0, m.t AS tm, l.t AS t1, l.px - f.px AS dx, m.r_ref FROM win
  JOIN pl f ON f.pulse = start JOIN pl m ON m.pulse = start + per // 2 JOIN pl l ON l.pulse = start + per - 1)
SELECT look::BIGINT AS look, {_r("t0", "t0")}, {_r("tm", "centre_time")}, {_r("t1 - t0", "t_dwell")},
  {_r("abs(dx) / (t1 - t0)", "v_platform")}, {_r("r_ref", "r0")}, {_r("acos(5000.0 / r_ref)", "incidence")},
  {_r("(t1 - t0) / 7.0", "azimuth_time_interval")} FROM edge
"""

AZIMUTH_RESOLUTIONS = f"""
WITH {PULSES}
SELECT l.pulse + 1 AS pulse_count, {_r("0.03125::DOUBLE * m.r_ref / (2.0 * abs(l.px - f.px))", "resolution")}
FROM pl l JOIN pl m ON m.pulse = (l.pulse + 1) // 2 JOIN pl f ON f.pulse = 0 WHERE l.pulse >= 1
"""
COLLECT_SHAPE = f"""
WITH {PULSES}
SELECT {_r("m.r_ref", "slant_range")}, {_r("abs(l.px - f.px)", "aperture")}, {_r("acos(5000.0 / m.r_ref)", "incidence")}
FROM np JOIN pl f ON f.pulse = 0 JOIN pl m ON m.pulse = n // 2 JOIN pl l ON l.pulse = n - 1
"""

# -- tracking -----------------------------------------------------------------------

TILE = """
tile AS (SELECT film, look, w AS iaz, az - 2 * w AS a, rg AS r, re, im FROM film JOIN range(3) t(w) ON az >= 2 * w AND az < 2 * w + 4)
"""
FILM = f"""
film AS (SELECT vec_id // 64 AS film, vec_id % 64 AS look, i // 4 AS az, i % 4 AS rg,
    embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im FROM embeddings, range(32) r(i)),
{TILE}
"""

LAMBDA = "(299792458.0::DOUBLE / 9.6e9)"
SPEED = "(1.0::DOUBLE * 7500.0 / 600000.0)"


def _track_body(reference: str, film: str, gate: float, exhaustive: bool = False) -> str:
    """Tables up to ``los``: every window's motion in every look."""
    lag = {"first": None, "adjacent": 1, "lag": 3, "pair": 0}[reference]
    if reference == "first":
        ref_look, measured = "0", "c.look > 0"
    elif reference == "pair":
        ref_look, measured = "c.look", "TRUE"
    else:
        ref_look, measured = f"c.look - {lag}", f"c.look >= {lag}"
    moved = "tile"
    slave = ""
    if reference == "pair":
        moved = "flip"
        slave = """
flipped AS (SELECT film, look, (az + 1) % 8 AS az, rg, re, im FROM film),
flip AS (SELECT film, look, w AS iaz, az - 2 * w AS a, rg AS r, re, im FROM flipped JOIN range(3) t(w) ON az >= 2 * w AND az < 2 * w + 4),
"""
    anchor = "c.look" if reference == "pair" else "0"

    def transform(source: str, out: str) -> str:
        angle = "2 * pi() * ((u - CASE WHEN u < 2 THEN 0 ELSE 4 END) * a + (v - CASE WHEN v < 2 THEN 0 ELSE 4 END) * r) / 4.0::DOUBLE"
        return f"""
{out}_m AS (SELECT *, re - avg(re) OVER w0 AS zr, im - avg(im) OVER w0 AS zi FROM {source}
  WINDOW w0 AS (PARTITION BY film, look, iaz)),
{out} AS (SELECT film, look, iaz, u, v, sum(zr * cos({angle}) + zi * sin({angle})) AS fr,
    sum(zi * cos({angle}) - zr * sin({angle})) AS fi
  FROM {out}_m, range(4) q(u), range(4) s(v) GROUP BY film, look, iaz, u, v)"""

    second = transform(moved, "fb") if reference == "pair" else "fb AS (SELECT * FROM fa)"
    shift_az = "shift_az"
    shift_rg = "shift_rg"
    accumulate = ""
    if reference == "adjacent":
        accumulate = " OVER (PARTITION BY film, iaz ORDER BY look)"
        shift_az, shift_rg = f"sum(shift_az){accumulate}", f"sum(shift_rg){accumulate}"
    # Quarter steps round the integer peak, or everywhere.
    if exhaustive:
        at_az, at_rg = (f"(CASE WHEN {k} > 8 THEN {k} - 16 ELSE {k} END) / 4.0::DOUBLE" for k in "ij")
        tried, own = "cx, range(16) q(i), range(16) s(j)", ""
    else:
        at_az, at_rg = "ca + (i - 4) / 4.0::DOUBLE", "cr + (j - 4) / 4.0::DOUBLE"
        tried, own = "cx JOIN pk USING (film, look, iaz), range(9) q(i), range(9) s(j)", "ca, cr,"
    fu, fv = "(u - CASE WHEN u < 2 THEN 0 ELSE 4 END)", "(v - CASE WHEN v < 2 THEN 0 ELSE 4 END)"
    turn = f"2 * pi() * ({fu} * ({at_az}) + {fv} * ({at_rg})) / 4.0::DOUBLE"
    return f"""
{film}, {slave}
{transform("tile", "fa")}, {second},
cx AS (SELECT c.film, c.look, c.iaz, c.u, c.v, p.fr * c.fr + p.fi * c.fi AS xr, p.fr * c.fi - p.fi * c.fr AS xi,
    p.fr ** 2 + p.fi ** 2 AS ep, c.fr ** 2 + c.fi ** 2 AS ec
  FROM fb c JOIN fa p ON p.film = c.film AND p.iaz = c.iaz AND p.u = c.u AND p.v = c.v AND p.look = {ref_look}
  WHERE {measured}),
nm AS (SELECT film, look, iaz, sqrt(sum(ep) * sum(ec)) AS norm FROM cx GROUP BY film, look, iaz),
co AS (SELECT film, look, iaz, m, n, sum(xr * cos(2 * pi() * (u * m + v * n) / 4.0::DOUBLE) - xi * sin(2 * pi() * (u * m + v * n) / 4.0::DOUBLE)) ** 2
    + sum(xr * sin(2 * pi() * (u * m + v * n) / 4.0::DOUBLE) + xi * cos(2 * pi() * (u * m + v * n) / 4.0::DOUBLE)) ** 2 AS mag
  FROM cx, range(4) q(m), range(4) s(n) GROUP BY film, look, iaz, m, n),
pk AS (SELECT film, look, iaz, CASE WHEN m > 2 THEN m - 4 ELSE m END AS ca, CASE WHEN n > 2 THEN n - 4 ELSE n END AS cr
  FROM co QUALIFY row_number() OVER (PARTITION BY film, look, iaz ORDER BY mag DESC, m, n) = 1),
fine AS (SELECT film, look, iaz, {at_az} AS sa, {at_rg} AS sr, i, j,
    sqrt(sum(xr * cos({turn}) - xi * sin({turn})) ** 2 + sum(xr * sin({turn}) + xi * cos({turn})) ** 2) AS mag
  FROM {tried} GROUP BY film, look, iaz, {own} i, j),
best AS (SELECT film, look, iaz, sa, sr, mag FROM fine
  QUALIFY row_number() OVER (PARTITION BY film, look, iaz ORDER BY mag DESC, i, j) = 1),
dots AS (SELECT c.film, c.look, c.iaz, sum(c.re * p.re + c.im * p.im) AS dr, sum(c.im * p.re - c.re * p.im) AS di
  FROM {moved} c JOIN tile p ON p.film = c.film AND p.iaz = c.iaz AND p.a = c.a AND p.r = c.r AND p.look = {anchor} GROUP BY ALL),
frames AS (SELECT DISTINCT f.film, l.i AS look, w.i AS iaz FROM film f, range(64) l(i), range(3) w(i)),
pairs AS (SELECT film, look, iaz, {measured.replace("c.look", "look")} AS ok, coalesce(sa, 0.0) AS shift_az, coalesce(sr, 0.0) AS shift_rg,
    CASE WHEN {measured.replace("c.look", "look")} THEN CASE WHEN norm > 0 THEN least(1.0, mag / norm) ELSE 0.0 END END AS peak,
    CASE WHEN {measured.replace("c.look", "look")} THEN coalesce(atan2(di, dr), 0.0) ELSE 0.0 END AS phase
  FROM frames LEFT JOIN best USING (film, look, iaz) LEFT JOIN nm USING (film, look, iaz) LEFT JOIN dots USING (film, look, iaz)),
mv AS (SELECT *, CASE WHEN ok THEN {shift_az} ELSE 0.0 END AS da, CASE WHEN ok THEN {shift_rg} ELSE 0.0 END AS dg,
    coalesce(avg(peak) OVER w1, 0.0) AS quality, atan2(sum(sin(phase)) OVER w1, sum(cos(phase)) OVER w1) AS mean
  FROM pairs WINDOW w1 AS (PARTITION BY film, iaz)),
los AS (SELECT *, -{LAMBDA} / (4 * pi()) * atan2(sin(phase - mean), cos(phase - mean)) AS dl, quality < {gate} AS low FROM mv)
"""


def _track(reference: str, exhaustive: bool = False) -> str:
    return f"""
WITH {_track_body(reference, FILM, 0.62, exhaustive)}
SELECT film, iaz::BIGINT AS win, iaz::BIGINT AS iaz, 0::BIGINT AS irg, look::BIGINT AS look,
  {_r("CASE WHEN low THEN 0.0 ELSE da END", "disp_az")}, {_r("CASE WHEN low THEN 0.0 ELSE dg END", "disp_rg")},
  {_r(f"CASE WHEN low THEN 0.0 ELSE da * {SPEED} END", "vel_los")}, {_r("CASE WHEN low THEN 0.0 ELSE dl END", "disp_los")},
  {_r("phase", "phase")}, {_r("quality", "quality")} FROM los
"""


PHASE = f"""
WITH {FILM},
z AS (SELECT *, sqrt((re - avg(re) OVER w0) ** 2 + (im - avg(im) OVER w0) ** 2) AS amp FROM tile WHERE look = 0
  WINDOW w0 AS (PARTITION BY film, iaz)),
b AS (SELECT film, iaz, a, r FROM z QUALIFY row_number() OVER (PARTITION BY film, iaz ORDER BY amp DESC, a, r) = 1),
s AS (SELECT t.film, t.iaz, t.look, t.re, t.im FROM tile t JOIN b USING (film, iaz, a, r)),
m AS (SELECT *, atan2(sum(im) OVER w1, sum(re) OVER w1) AS mean, avg(sqrt(re * re + im * im)) OVER w1 AS ma,
    avg(re * re + im * im) OVER w1 AS ms FROM s WINDOW w1 AS (PARTITION BY film, iaz)),
p AS (SELECT *, atan2(sin(atan2(im, re) - mean), cos(atan2(im, re) - mean)) AS psi,
    CASE WHEN ma > 0 THEN greatest(0.0, least(1.0, 1 - sqrt(greatest(ms - ma * ma, 0)) / ma)) ELSE 0.0 END AS quality FROM m),
d AS (SELECT *, psi * (-{LAMBDA} / (4 * pi())) AS dl, quality < 0.45 AS low FROM p),
v AS (SELECT *, coalesce((dl - lag(dl) OVER (PARTITION BY film, iaz ORDER BY look)) / 0.25, 0.0) AS vl FROM d)
SELECT film, iaz::BIGINT AS win, iaz::BIGINT AS iaz, 0::BIGINT AS irg, look::BIGINT AS look, 0.0::DOUBLE AS disp_az, 0.0::DOUBLE AS disp_rg,
  {_r("CASE WHEN low THEN 0.0 ELSE vl END", "vel_los")}, {_r("CASE WHEN low THEN 0.0 ELSE dl END", "disp_los")},
  {_r("CASE WHEN low THEN 0.0 ELSE psi END", "phase")}, {_r("quality", "quality")} FROM v
"""

DEMEAN = f"""
WITH {FILM}
SELECT film, look, {_r("avg(re)", "mre")}, {_r("avg(im)", "mim")},
  {_r("avg(re * re + im * im) - avg(re) ** 2 - avg(im) ** 2", "residual")} FROM film GROUP BY film, look
"""

# -- event series and spectra ---------------------------------------------------------

N = t.EVENT_LOOKS
SERIES = f"""
span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
slot AS (SELECT user_id AS win, ((epoch_us(ts) - lo) * {N}) // (hi - lo + 1) AS look, avg(value) AS v, count(*)::DOUBLE AS c
  FROM events, span GROUP BY 1, 2),
wins AS (SELECT win, count(*) / {N}.0::DOUBLE AS quality FROM slot GROUP BY win),
ser AS (SELECT w.win, l.i AS look, w.quality, coalesce(v, 0.0) AS v, coalesce(c, 0.0) AS c
  FROM wins w CROSS JOIN range({N}) l(i) LEFT JOIN slot s ON s.win = w.win AND s.look = l.i)
"""


def _psd(scale: str, detrend: str = "linear", series: str = SERIES) -> str:
    slope = f"regr_slope({scale}, look)" if detrend == "linear" else "0.0"
    return f"""
{series},
fit AS (SELECT win, avg({scale}) AS m, {slope} AS b FROM (SELECT win, look::DOUBLE AS look, v FROM ser) GROUP BY win),
tap AS (SELECT i AS look, 0.5 * (1 - cos(2 * pi() * i / {N - 1}.0::DOUBLE)) AS h FROM range({N}) r(i)),
tp AS (SELECT sum(h * h) AS hp FROM tap),
dt AS (SELECT s.win, s.look, ({scale.replace("v", "s.v")} - m - b * (s.look - {(N - 1) / 2})) * h AS y
  FROM ser s JOIN fit USING (win) JOIN tap USING (look)),
ft AS (SELECT win, k, sum(y * cos(2 * pi() * k * look / {N}.0::DOUBLE)) AS fr, sum(y * sin(2 * pi() * k * look / {N}.0::DOUBLE)) AS fi
  FROM dt, range({N // 2 + 1}) f(k) GROUP BY win, k),
psd AS (SELECT win, k, CASE WHEN k = 0 OR k = {N // 2} THEN 1.0 ELSE 2.0 END * (fr * fr + fi * fi) * 0.25 / hp AS psd FROM ft, tp),
exc AS (SELECT win, max(v) - min(v) AS exc, any_value(quality) AS quality FROM ser GROUP BY win)
"""


def _windows(scale: str, k_min: int = 1, detrend: str = "linear", series: str = SERIES) -> str:
    return f"""
{_psd(scale, detrend, series)},
top AS (SELECT win, k AS bin, psd AS peak FROM psd WHERE k >= {k_min}
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY psd DESC, k) = 1),
mn AS (SELECT win, avg(psd) AS mean FROM psd WHERE k >= {k_min} GROUP BY win),
sp AS (SELECT win, win // 15 AS iaz, win % 15 AS irg, quality, exc, bin, bin / 16.0::DOUBLE AS freq, sqrt(peak) AS amp,
    CASE WHEN mean > 0 THEN peak / mean ELSE 0.0 END AS prom
  FROM top JOIN mn USING (win) JOIN exc USING (win))
"""


VEL = "v * 0.01::DOUBLE"
SP = _windows(VEL)
_SP_OUT = f"""
SELECT win, iaz::BIGINT AS iaz, irg::BIGINT AS irg, {_r("quality", "quality")}, {_r("exc", "excursion_px")},
  bin::BIGINT AS dominant_bin, {_r("freq", "dominant_freq")}, {_r("amp", "amplitude")}, {_r("prom", "prominence")} FROM sp
"""
# The whole chain: pulses, 64 looks of an 8 x 4 scene, motion, spectrum.
CHAIN = f"""
{_looking(64, 4)},
s AS (SELECT pulse, az, rg, ph, {_lerp(1)} AS sr, {_lerp(2)} AS si FROM f),
film AS (SELECT 0 AS film, look, az, rg, sum(sr * cos(ph) - si * sin(ph)) AS re, sum(sr * sin(ph) + si * cos(ph)) AS im
  FROM s JOIN win ON pulse >= start AND pulse < start + per GROUP BY look, az, rg),
{_track_body("first", TILE, 0.0)},
ser AS (SELECT iaz AS win, look, quality, da AS v, 0.0 AS c FROM los)
"""
PULSES_TO_SPECTRUM = f"""
WITH {_windows(f"v * {SPEED}", series=CHAIN)}
SELECT win::BIGINT AS win, win::BIGINT AS iaz, 0::BIGINT AS irg, {_r("quality", "quality")}, {_r("exc", "excursion_px")},
  bin::BIGINT AS dominant_bin, {_r("freq", "dominant_freq")}, {_r("amp", "amplitude")}, {_r("prom", "prominence")} FROM sp
"""
def _linked(steps: int) -> str:
    """Fixed-point phase linking of both sub-bands, one table a step."""
    out = "x0 AS MATERIALIZED (SELECT film, band, look, 1.0::DOUBLE AS xr, 0.0::DOUBLE AS xi, 0.0::DOUBLE AS moved FROM lk, range(2) b(band)),\n"
    for k in range(steps):
        out += f"""p{k} AS (SELECT g.film, g.band, g.i AS look, sum(g.cr * x.xr - g.ci * x.xi) AS pr, sum(g.cr * x.xi + g.ci * x.xr) AS pi
  FROM gam g JOIN x{k} x ON x.film = g.film AND x.band = g.band AND x.look = g.j WHERE g.i <> g.j GROUP BY g.film, g.band, g.i),
x{k + 1} AS MATERIALIZED (SELECT film, band, look, nr AS xr, ni AS xi, sqrt((nr - xr) ** 2 + (ni - xi) ** 2) AS moved FROM (
  SELECT x.film, x.band, x.look, x.xr, x.xi, CASE WHEN pr * pr + pi * pi > 0 THEN pr / sqrt(pr * pr + pi * pi) ELSE xr END AS nr,
    CASE WHEN pr * pr + pi * pi > 0 THEN pi / sqrt(pr * pr + pi * pi) ELSE xi END AS ni FROM x{k} x LEFT JOIN p{k} USING (film, band, look))),
"""
    settled = " UNION ALL ".join(f"SELECT film, band, {k} AS k, sum(moved) AS moved FROM x{k} GROUP BY film, band" for k in range(1, steps + 1))
    return out + f"settled AS (SELECT film, bool_and(ok) AS converged FROM (SELECT film, band, bool_or(moved < 1e-9) AS ok FROM ({settled}) GROUP BY film, band) GROUP BY film)"


_GRAM = "sum(a.sr * b.sr + a.si * b.si) AS gr, sum(a.si * b.sr - a.sr * b.si) AS gi"
SPLITBAND = f"""
WITH RECURSIVE {FILM.rsplit("tile AS", 1)[0].rstrip().rstrip(",")},
lk AS (SELECT DISTINCT film, look FROM film),
dm AS (SELECT film, look, az, rg, re - avg(re) OVER w0 AS re, im - avg(im) OVER w0 AS im FROM film WINDOW w0 AS (PARTITION BY film, look)),
sp AS (SELECT film, look, rg, k, sum(re * cos(2 * pi() * (k - 4) * az / 8.0::DOUBLE) + im * sin(2 * pi() * (k - 4) * az / 8.0::DOUBLE)) AS sr,
    sum(im * cos(2 * pi() * (k - 4) * az / 8.0::DOUBLE) - re * sin(2 * pi() * (k - 4) * az / 8.0::DOUBLE)) AS si
  FROM dm, range(8) q(k) GROUP BY film, look, rg, k),
pw AS (SELECT film, list(p ORDER BY k) AS p, sum(p) AS total FROM (SELECT film, k, sum(sr * sr + si * si) AS p FROM sp GROUP BY film, k) GROUP BY film),
grow(film, lo, hi, held) AS (
  SELECT film, list_position(p, list_max(p)) - 1, list_position(p, list_max(p)) - 1, list_max(p) FROM pw
  UNION ALL
  SELECT film, CASE WHEN above >= below THEN lo ELSE lo - 1 END, CASE WHEN above >= below THEN hi + 1 ELSE hi END, held + greatest(above, below)
  FROM (SELECT g.film, lo, hi, held, CASE WHEN lo > 0 THEN p[lo] ELSE -1.0 END AS below, CASE WHEN hi < 7 THEN p[hi + 2] ELSE -1.0 END AS above
    FROM grow g JOIN pw ON pw.film = g.film WHERE held < 0.9::DOUBLE * total AND (lo > 0 OR hi < 7))),
bd AS (SELECT film, min(lo) AS lo, max(hi) AS hi, max(hi) - min(lo) + 1 AS width FROM grow GROUP BY film),
part AS (SELECT s.*, band FROM sp s JOIN bd USING (film), range(2) b(band) WHERE width >= 6
  AND CASE WHEN band = 0 THEN k >= lo AND k < lo + width // 3 ELSE k >= hi + 1 - width // 3 AND k <= hi END),
gm AS (SELECT a.film, a.band, a.look AS i, b.look AS j, {_GRAM} FROM part a JOIN part b ON b.film = a.film AND b.band = a.band AND b.rg = a.rg AND b.k = a.k
  GROUP BY a.film, a.band, a.look, b.look),
gam AS MATERIALIZED (SELECT g.film, g.band, g.i, g.j, CASE WHEN u.gr * v.gr > 0 THEN g.gr / sqrt(u.gr * v.gr) ELSE 0.0 END AS cr,
    CASE WHEN u.gr * v.gr > 0 THEN g.gi / sqrt(u.gr * v.gr) ELSE 0.0 END AS ci
  FROM gm g JOIN gm u ON u.film = g.film AND u.band = g.band AND u.i = g.i AND u.j = g.i JOIN gm v ON v.film = g.film AND v.band = g.band AND v.i = g.j AND v.j = g.j),
{_linked(32)},
ph AS (SELECT x.film, x.band, x.look, atan2(x.xi * z.xr - x.xr * z.xi, x.xr * z.xr + x.xi * z.xi) AS phase
  FROM x32 x JOIN x32 z ON z.film = x.film AND z.band = x.band AND z.look = 0),
sh AS (SELECT u.film, u.look, CASE WHEN u.look = 0 THEN 0.0 ELSE atan2(sin(u.phase - l.phase), cos(u.phase - l.phase)) * (-3.0) / (4 * pi() * width / 8.0::DOUBLE) END AS shift
  FROM ph u JOIN ph l ON l.film = u.film AND l.look = u.look AND l.band = 0 JOIN bd ON bd.film = u.film WHERE u.band = 1),
wg AS (SELECT a.film, a.look AS i, b.look AS j, {_GRAM} FROM sp a JOIN sp b ON b.film = a.film AND b.rg = a.rg AND b.k = a.k AND b.look >= a.look GROUP BY a.film, a.look, b.look),
qu AS (SELECT g.film, avg(sqrt((g.gr ** 2 + g.gi ** 2) / (u.gr * v.gr))) AS quality
  FROM wg g JOIN wg u ON u.film = g.film AND u.i = g.i AND u.j = g.i JOIN wg v ON v.film = g.film AND v.i = g.j AND v.j = g.j
  WHERE g.i < g.j AND u.gr * v.gr > 0 GROUP BY g.film)
SELECT f.film, 0::BIGINT AS win, 0::BIGINT AS iaz, 0::BIGINT AS irg, l.look::BIGINT AS look, {_r("coalesce(shift, 0.0)", "disp_az")}, 0.0 AS disp_rg,
  {_r(f"coalesce(shift, 0.0) * {SPEED}", "vel_los")}, 0.0 AS disp_los, 0.0 AS phase,
  {_r("CASE WHEN width >= 6 THEN coalesce(quality, 0.0) ELSE 0.0 END", "quality")}, width < 6 OR converged AS converged
FROM bd f CROSS JOIN range(64) l(look) LEFT JOIN sh ON sh.film = f.film AND sh.look = l.look LEFT JOIN qu ON qu.film = f.film LEFT JOIN settled st ON st.film = f.film
"""

# The look shuffle: a 32-bit generator and the swaps it drives, one row a step; orders are complete where i = 0.
WORD = "4294967295"
SHUFFLED = f"""
pm(trial, i, state, ord) AS (
  SELECT 0::BIGINT, 63::BIGINT, 1::BIGINT, range(64)
  UNION ALL
  SELECT CASE WHEN i = 0 THEN trial + 1 ELSE trial END, CASE WHEN i = 0 THEN 63 ELSE i - 1 END,
    CASE WHEN i = 0 THEN ((trial + 1) * 2654435761 + 1) & {WORD} ELSE x END,
    CASE WHEN i = 0 THEN ord ELSE list_transform(range(64), lambda k: CASE WHEN k = i THEN ord[j + 1] WHEN k = j THEN ord[i + 1] ELSE ord[k + 1] END) END
  FROM (SELECT *, x % (i + 1) AS j FROM (SELECT *, xor(b, (b << 5) & {WORD}) AS x FROM (SELECT *, xor(a, a >> 17) AS b
    FROM (SELECT *, xor(state, (state << 13) & {WORD}) AS a FROM pm WHERE NOT (trial = 3 AND i = 0)))))),
placed AS (SELECT trial, unnest(ord) AS look, unnest(range(64)) AS spot FROM pm WHERE i = 0),
film AS (SELECT vec_id // 64 * 4 + trial AS film, spot AS look, i // 4 AS az, i % 4 AS rg,
    embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im
  FROM embeddings JOIN placed ON look = vec_id % 64, range(32) r(i)),
{_track_body("first", TILE, 0.0)},
ser AS (SELECT film * 3 + iaz AS win, look, quality, da AS v, 0.0 AS c FROM los)
"""
SHUFFLE_NULL = f"""
WITH RECURSIVE {_windows(f"v * {SPEED}", series=SHUFFLED)},
ga AS (SELECT *, win // 3 AS run, quality >= 0.5 * greatest(max(quality) OVER (PARTITION BY win // 3), 0) AND exc >= 2.449::DOUBLE / 4 AS passed FROM sp),
pr AS (SELECT run, coalesce(max(prom) FILTER (WHERE passed), 0.0) AS p FROM ga GROUP BY run)
SELECT 5.0::DOUBLE AS "real", {_r("avg(p)", "mean")}, {_r("stddev_pop(p)", "sd")}, {_r("max(p)", "worst")}, count(*) AS n_trials,
  count(*) FILTER (WHERE p >= 5.0) AS n_ge, {_r("(count(*) FILTER (WHERE p >= 5.0) + 1) / (count(*) + 1.0::DOUBLE)", "p_value")} FROM pr
"""
PSD = f"WITH {_psd(VEL)} SELECT win, k::BIGINT AS k, {_r('k / 16.0::DOUBLE', 'freq')}, {_r('psd', 'psd')} FROM psd"
WINDOWS = f"WITH {SP} {_SP_OUT}"
DISPLACEMENT = f"WITH {_windows('v * 0.001::DOUBLE', 5, 'mean')} {_SP_OUT}"

FLOOR = "(2.449::DOUBLE * 60.0)"
GATED = f"{SP}, ga AS (SELECT *, quality >= 0.5 * max(quality) OVER () AND exc >= {FLOOR} AS passed FROM sp)"
BEST = f"""
WITH {GATED}
SELECT b.win, {_r("freq", "dominant_freq")}, {_r("prom", "prominence")}, {_r("quality", "quality")}, {_r("exc", "excursion_px")},
  (SELECT count(*) FROM ga WHERE passed) AS n_candidates
FROM (SELECT * FROM ga WHERE passed ORDER BY prom DESC, win LIMIT 1) b
"""
VOTES = f"""
{GATED},
vo AS (SELECT win, freq FROM ga WHERE passed),
ag AS (SELECT a.win, a.freq, count(*) AS n, min(b.win) AS earliest FROM vo a JOIN vo b ON abs(a.freq - b.freq) <= 0.03125 GROUP BY a.win, a.freq),
cf AS (SELECT freq AS f0, n AS agree FROM ag ORDER BY n DESC, freq LIMIT 1)
"""
CONSENSUS = f"""
WITH {VOTES}
SELECT {_r("f0", "consensus_freq")}, agree::BIGINT AS n_agree, (SELECT count(*) FROM ag WHERE win = earliest) AS n_distinct,
  (SELECT count(*) FROM vo) AS n_voting, agree < (SELECT count(*) FROM vo) / 3.0 AS refused FROM cf
"""
MARKED = f"{VOTES}, mk AS (SELECT ga.*, passed AND abs(freq - f0) <= 0.03125 AS agrees FROM ga, cf)"
EVIDENCE = f"""
WITH {MARKED}
SELECT win, iaz::BIGINT AS iaz, irg::BIGINT AS irg, {_r("freq", "dominant_freq")}, {_r("prom", "prominence")}, {_r("quality", "quality")},
  {_r("exc", "excursion_px")}, passed, agrees FROM mk
"""


def _blocks(cells: str) -> str:
    return f"""
cells AS (SELECT win, iaz, irg FROM mk WHERE {cells}),
walk AS (
  SELECT win AS root, win, iaz, irg FROM cells
  UNION
  SELECT w.root, c.win, c.iaz, c.irg FROM walk w JOIN cells c ON abs(w.iaz - c.iaz) + abs(w.irg - c.irg) = 1),
lab AS (SELECT win, min(root) AS block FROM walk GROUP BY win),
sz AS (SELECT block, count(*) AS n FROM lab GROUP BY block)
"""


BLOCK = f"WITH RECURSIVE {MARKED}, {_blocks('agrees')} SELECT max(n) AS n_contiguous FROM sz"
ELIGIBLE = f"WITH RECURSIVE {MARKED}, {_blocks('passed')} SELECT n AS size, count(*) AS n_blocks FROM sz GROUP BY n"
REPORT = f"""
WITH RECURSIVE {MARKED}, {_blocks('agrees')},
b AS (SELECT *, (SELECT max(n) FROM sz) AS blk, (SELECT count(*) FROM ga WHERE passed) AS cand FROM ga WHERE passed ORDER BY prom DESC, win LIMIT 1),
e AS (SELECT *, 0.4::DOUBLE * freq AS eta FROM b)
SELECT win, {_r("freq", "dominant_freq")}, {_r("prom", "prominence")}, concat_ws(',',
  CASE WHEN freq >= 1.25 THEN 'above_band' END, CASE WHEN blk BETWEEN 1 AND 3 THEN 'scattered' END,
  CASE WHEN cand BETWEEN 1 AND 3 THEN 'few_candidates' END, CASE WHEN prom < 3 THEN 'flat_spectrum' END,
  CASE WHEN freq > 0 AND abs(sin(pi() * eta) / (pi() * eta)) < 0.1 THEN 'attenuated' END,
  CASE WHEN eta > 0.5 AND abs(eta - floor(eta + 0.5)) < 0.15 THEN 'near_null' END,
  CASE WHEN freq > 1.8 THEN 'near_nyquist' END) AS warnings FROM e
"""

REFERENCE = f"""
WITH {SERIES}
SELECT win, look::BIGINT AS look, {_r("coalesce(v - lag(v, 4) OVER w, 0.0)", "lagged")}, {_r("sum(v) OVER w", "accumulated")},
  {_r("coalesce((v * 0.001::DOUBLE - lag(v * 0.001::DOUBLE) OVER w) / 0.25, 0.0)", "rate")}
FROM ser WINDOW w AS (PARTITION BY win ORDER BY look)
"""
COMMON = f"""
WITH {SERIES},
md AS (SELECT look, quantile_cont(v, 0.5) AS mv, quantile_cont(c, 0.5) AS mc FROM ser GROUP BY look)
SELECT win, look::BIGINT AS look, {_r("v - mv", "disp_az")}, {_r("c - mc", "disp_rg")}, {_r(f"(v - mv) * {SPEED}", "vel_los", 8)}
FROM ser JOIN md USING (look)
"""

STATISTICS = f"""
WITH {SERIES},
sw AS (SELECT win, any_value(quality) AS quality, (max(v) - min(v)) AS p2p FROM ser GROUP BY win),
lg AS (SELECT 'vel_p2p' AS quantity, p2p * 0.01::DOUBLE AS value, 0.9::DOUBLE / 0.5 AS lim FROM sw
  UNION ALL SELECT 'disp_p2p', p2p * 0.001::DOUBLE, 0.45 FROM sw
  UNION ALL SELECT 'phase_step', 0.0, pi() FROM sw
  UNION ALL SELECT 'quality', quality, 'inf'::DOUBLE FROM sw)
SELECT quantity, count(*) AS n_windows, {_r("min(value)", "lowest")}, {_r("quantile_cont(value, 0.5)", "median")}, {_r("max(value)", "highest")},
  count(*) FILTER (WHERE value > lim) AS n_above, count(*) FILTER (WHERE value > 0.5 * lim) AS n_above_half FROM lg GROUP BY quantity
"""
STRONGEST = f"""
WITH {SP}
SELECT win, iaz::BIGINT AS iaz, irg::BIGINT AS irg, {_r("freq", "dominant_freq")}, {_r("prom", "prominence")} FROM sp ORDER BY prom DESC, win LIMIT 8
"""
CONTROL = f"""
WITH {SP},
nr AS (SELECT * FROM sp WHERE abs(freq - 1.0) < 2 * 0.0625::DOUBLE),
bt AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY irg ORDER BY prom DESC, win) = 1)
SELECT g.irg::BIGINT AS irg, b.win IS NOT NULL AS recovered, (SELECT count(*) FROM nr WHERE nr.irg = g.irg) AS n_recovered, b.win,
  {_r("b.freq", "frequency")}, {_r("b.prom", "prominence")}, {_r("g.q", "best_quality")}, {_r("g.m", "median_quality")}
FROM (SELECT irg, max(quality) AS q, quantile_cont(quality, 0.5) AS m FROM sp GROUP BY irg) g LEFT JOIN bt b ON b.irg = g.irg
"""

# -- depth ------------------------------------------------------------------------------

OBS = f"""
{SERIES},
obs AS (SELECT win, look, v - avg(v) OVER w AS yr, 0.5 * c - avg(0.5 * c) OVER w AS yi FROM ser WINDOW w AS (PARTITION BY win))
"""
KZ = "(4 * pi() * 75000.0 / (({lam}) * 500000.0 * sin(35.0::DOUBLE * pi() / 180.0)))"
# Fourier magnitudes of the tapered data vector.
MAG = f"""
{OBS},
mg AS (SELECT win, k, sqrt(sum(h * (yr * cos(2 * pi() * k * look / {N}.0::DOUBLE) + yi * sin(2 * pi() * k * look / {N}.0::DOUBLE))) ** 2
    + sum(h * (yi * cos(2 * pi() * k * look / {N}.0::DOUBLE) - yr * sin(2 * pi() * k * look / {N}.0::DOUBLE))) ** 2) AS mag
  FROM (SELECT *, 0.5 * (1 - cos(2 * pi() * look / {N - 1}.0::DOUBLE)) AS h FROM obs), range({N}) f(k) GROUP BY win, k)
"""
MODEL_A = f"""
{MAG},
ax AS (SELECT j, j * 0.5::DOUBLE / (2 * pi() / {KZ.format(lam="0.12::DOUBLE")}) AS fi FROM range(25) r(j)),
prof AS (SELECT a.win, j, j * 0.5::DOUBLE AS depth, a.mag * (1 - (fi - floor(fi))) + b.mag * (fi - floor(fi)) AS value
  FROM ax JOIN mg a ON a.k = floor(fi)::INT JOIN mg b ON b.win = a.win AND b.k = a.k + 1 WHERE fi >= 0 AND fi < {N - 1})
"""
_CELLS = f"SELECT win, j::BIGINT AS j, {_r('depth', 'depth')}, {_r('value', 'value', 4)} FROM prof"


def _least_squares(depths: int, ridge: float) -> str:
    """Model A by regularised normal equations, eliminated one unknown a table."""
    turn = f"{KZ.format(lam='0.12::DOUBLE')} * look / {N}.0::DOUBLE * 0.5"
    steps = "".join(
        f"""m{p + 1} AS MATERIALIZED (SELECT x.r, x.c, CASE WHEN x.r = {p} THEN x.v / d.v ELSE x.v - f.v * y.v / d.v END AS v
  FROM m{p} x JOIN m{p} y ON y.r = {p} AND y.c = x.c JOIN m{p} f ON f.r = x.r AND f.c = {p} JOIN m{p} d ON d.r = {p} AND d.c = {p}
  WHERE x.c > {p}),
"""
        for p in range(2 * depths)
    )
    return f"""
WITH {OBS},
gm AS (SELECT a.j AS r, b.j AS c, sum(cos({turn} * (b.j - a.j))) + CASE WHEN a.j = b.j THEN {ridge * N}::DOUBLE ELSE 0.0 END AS gr,
    sum(sin({turn} * (b.j - a.j))) AS gi FROM range({depths}) a(j), range({depths}) b(j), range({N}) l(look) GROUP BY a.j, b.j),
rhs AS (SELECT win, j AS r, sum(cos({turn} * j) * yr + sin({turn} * j) * yi) AS br, sum(cos({turn} * j) * yi - sin({turn} * j) * yr) AS bi
  FROM obs, range({depths}) r(j) GROUP BY win, j),
m0 AS MATERIALIZED (SELECT r, c, gr AS v FROM gm UNION ALL SELECT r, c + {depths}, -gi FROM gm
  UNION ALL SELECT r + {depths}, c, gi FROM gm UNION ALL SELECT r + {depths}, c + {depths}, gr FROM gm
  UNION ALL SELECT r, 1000 + win, br FROM rhs UNION ALL SELECT r + {depths}, 1000 + win, bi FROM rhs),
{steps}prof AS (SELECT a.c - 1000 AS win, a.r AS j, a.r * 0.5::DOUBLE AS depth, sqrt(a.v * a.v + b.v * b.v) AS value
  FROM m{2 * depths} a JOIN m{2 * depths} b ON b.c = a.c AND b.r = a.r + {depths} WHERE a.r < {depths})
{_CELLS}
"""


MODEL_C = f"""
WITH {OBS},
kz AS (SELECT i AS look, 4 * pi() * (1000.0::DOUBLE * i / {N - 1}) / (0.031::DOUBLE * 500000.0 * sin(35.0::DOUBLE * pi() / 180.0)) AS kz FROM range({N}) r(i)),
prof AS (SELECT win, j, j * 10.0::DOUBLE AS depth, sqrt(sum(yr * cos(kz * j * 10.0) + yi * sin(kz * j * 10.0)) ** 2
    + sum(yi * cos(kz * j * 10.0) - yr * sin(kz * j * 10.0)) ** 2) / {N} AS value
  FROM obs JOIN kz USING (look), range(5) r(j) GROUP BY win, j)
{_CELLS}
"""
# Standing waves: 100 m/s, half wavelength 100 / (2 f) / 2 with f = k / 16.
MODEL_B = f"""
WITH {_psd(VEL)},
ord AS (SELECT k, n * (100.0::DOUBLE / (2.0 * k / 16.0::DOUBLE) / 2.0) AS d FROM range(1, {N // 2 + 1}) f(k), range(1, 200) o(n)
  WHERE n * (100.0::DOUBLE / (2.0 * k / 16.0::DOUBLE) / 2.0) <= 60.0),
g AS (SELECT k, j, sum(exp(-0.5 * ((j * 20.0 - d) / 20.0) ** 2)) AS g FROM ord, range(4) r(j) WHERE abs((j * 20.0 - d) / 20.0) <= 3 GROUP BY k, j),
prof AS (SELECT win, j, j * 20.0::DOUBLE AS depth, sum(sqrt(psd) * g) AS value FROM psd JOIN g USING (k) GROUP BY win, j)
{_CELLS}
"""


def _resonance(v: float) -> str:
    return f"""
rs AS (SELECT k, floor({v}::DOUBLE / (2 * k / 16.0::DOUBLE) / 5.0 + 0.5)::INT AS j FROM range(1, {N // 2 + 1}) f(k)
  WHERE {v}::DOUBLE / (2 * k / 16.0::DOUBLE) <= 60.0),
hit AS (SELECT win, j, avg(psd) AS value FROM psd JOIN rs USING (k) GROUP BY win, j),
prof AS (SELECT w.win, r.j, r.j * 5.0::DOUBLE AS depth, coalesce(value, 0.0) AS value
  FROM (SELECT DISTINCT win FROM psd) w CROSS JOIN range(13) r(j) LEFT JOIN hit ON hit.win = w.win AND hit.j = r.j)
"""


MODEL_D = f"WITH {_psd(VEL)}, {_resonance(100.0)} {_CELLS}"

PULSES_TO_DEPTH = f"""
WITH {_psd(f"v * {SPEED}", series=CHAIN)}, {_resonance(100.0)}
SELECT win::BIGINT AS win, j::BIGINT AS j, {_r("depth", "depth")}, {_r("value", "value", 8)} FROM prof
"""

PEAKS = f"""
WITH {MODEL_A},
pk AS (SELECT win, depth, value FROM prof WHERE j >= 1 QUALIFY row_number() OVER (PARTITION BY win ORDER BY value DESC, j) = 1)
SELECT win, {_r("quality", "quality")}, {_r("depth", "peak_depth")}, {_r("value", "peak_value", 4)} FROM pk JOIN wins USING (win)
"""


def _interpolated(group: str, cell: float) -> str:
    """Parabola-refined peak of ``mean(group, j, m)``."""
    part = f"PARTITION BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    return f"""
nb AS (SELECT *, lag(m) OVER ({part} ORDER BY j) AS y0, lead(m) OVER ({part} ORDER BY j) AS y2 FROM mean),
bp AS (SELECT * FROM nb WHERE j >= 1 QUALIFY row_number() OVER ({part} ORDER BY m DESC, j) = 1),
ip AS (SELECT {lead}(j + CASE WHEN y2 IS NULL OR y0 - 2 * m + y2 = 0 THEN 0.0
    ELSE greatest(-1.0, least(1.0, 0.5 * (y0 - y2) / (y0 - 2 * m + y2))) END) * {cell}::DOUBLE AS peak_depth, m AS peak_value FROM bp)
"""


PROFILE_PEAK = f"""
WITH {MODEL_A}, mean AS (SELECT j, avg(value) AS m FROM prof GROUP BY j), {_interpolated("", 0.5)}
SELECT {_r("peak_depth", "peak_depth")}, {_r("peak_value", "peak_value", 4)} FROM ip
"""
CONTRAST = f"""
WITH {MODEL_A}, tot AS (SELECT j, sum(value) AS s FROM prof GROUP BY j)
SELECT {_r("max(s) / quantile_cont(s, 0.5)", "contrast")} FROM tot
"""
ALIGNMENT = f"""
WITH {MODEL_A},
sh AS (SELECT win, tr, ('0x' || substr(md5('7:' || tr::VARCHAR || ':' || win::VARCHAR), 1, 8))::BIGINT % 25 AS s FROM wins, range(16) r(tr)),
tot AS (SELECT tr, (j + s) % 25 AS j2, sum(value) AS v FROM prof JOIN sh USING (win) GROUP BY 1, 2),
ct AS (SELECT tr, max(v) / quantile_cont(v, 0.5) AS c FROM tot GROUP BY tr),
re AS (SELECT max(s) / quantile_cont(s, 0.5) AS r FROM (SELECT j, sum(value) AS s FROM prof GROUP BY j))
SELECT {_r("any_value(r)", "real")}, {_r("avg(c)", "mean")}, {_r("stddev_pop(c)", "sd")}, {_r("max(c)", "worst")},
  count(*) FILTER (WHERE c >= r) AS n_ge, {_r("(count(*) FILTER (WHERE c >= r) + 1) / 17.0::DOUBLE", "p_value")} FROM ct, re
"""
SCALES = "sc AS (SELECT 0.5::DOUBLE * 2 ** i AS s FROM range(3) r(i))"
SWEEP = f"""
WITH {MAG}, {SCALES},
asm AS (SELECT a.s * 3000.0 AS velocity, b.s * 12500.0 AS frequency, a.s * 3000.0 / (2 * b.s * 12500.0) AS lam FROM sc a, sc b),
ok AS (SELECT *, lam * 500000.0 / 150000.0 AS res, 2 * pi() / {KZ.format(lam="lam")} AS step FROM asm
  WHERE lam * 500000.0 / 150000.0 <= 1.0 AND 2 * pi() * {N} / {KZ.format(lam="lam")} >= 8.0),
mm AS (SELECT k, avg(mag) AS mag FROM mg GROUP BY k),
ax AS (SELECT velocity, frequency, j, j / step AS fi FROM ok, range(9) r(j)),
mean AS (SELECT velocity, frequency, j, CASE WHEN fi < {N - 1} THEN a.mag * (1 - (fi - floor(fi))) + coalesce(b.mag, 0) * (fi - floor(fi)) ELSE 0.0 END AS m
  FROM ax LEFT JOIN mm a ON a.k = floor(fi)::INT LEFT JOIN mm b ON b.k = floor(fi)::INT + 1),
{_interpolated("velocity, frequency", 1.0)}
SELECT {_r("velocity", "velocity")}, {_r("frequency", "frequency")}, {_r("lam", "lambda_ac")}, {_r("res", "resolution")},
  {_r("peak_depth", "peak_depth")}, {_r("peak_value", "peak_value", 4)} FROM ip JOIN ok USING (velocity, frequency)
"""
SWEEP_D = f"""
WITH {_psd(VEL)}, {SCALES},
asm AS (SELECT a.s * 100.0 AS velocity, b.s * 50.0 AS frequency, a.s * 100.0 / (2 * b.s * 50.0) AS lam FROM sc a, sc b),
ok AS (SELECT *, lam * 500000.0 / 150000.0 AS res FROM asm WHERE velocity >= 100 AND lam * 500000.0 / 150000.0 <= 5.0),
mp AS (SELECT k, avg(psd) AS p FROM psd GROUP BY k),
rs AS (SELECT velocity, frequency, k, floor(velocity / (2 * k / 16.0::DOUBLE) / 5.0 + 0.5)::INT AS j FROM ok, range(1, {N // 2 + 1}) f(k)
  WHERE velocity / (2 * k / 16.0::DOUBLE) <= 60.0),
hit AS (SELECT velocity, frequency, j, avg(p) AS value FROM rs JOIN mp USING (k) GROUP BY ALL),
mean AS (SELECT o.velocity, o.frequency, r.j, coalesce(value, 0.0) AS m FROM ok o CROSS JOIN range(13) r(j)
  LEFT JOIN hit h ON h.velocity = o.velocity AND h.frequency = o.frequency AND h.j = r.j),
{_interpolated("velocity, frequency", 5.0)}
SELECT {_r("velocity", "velocity")}, {_r("frequency", "frequency")}, {_r("lam", "lambda_ac")}, {_r("res", "resolution")},
  {_r("peak_depth", "peak_depth")}, {_r("peak_value", "peak_value", 4)} FROM ip JOIN ok USING (velocity, frequency)
"""
# The chain with every grid offset as a film of its own.
_AT_OFFSETS = _looking(64, 4).replace(
    "cell AS (SELECT a.i AS az", "cell AS (SELECT off, a.i AS az").replace("a.i - 3.5::DOUBLE AS gx", "a.i - 3.5::DOUBLE + ox AS gx").replace(
    "- 1.5::DOUBLE AS gy", "- 1.5::DOUBLE + oy AS gy").replace(
    "range(4) b(i)),", "range(4) b(i), (VALUES (0, 0.0, 0.0), (1, 3.0, 0.0), (2, 0.0, 2.0), (3, 3.0, 2.0)) o(off, ox, oy)),").replace(
    "d AS (SELECT pulse, e,", "d AS (SELECT off, pulse, e,")
_OFFSET_CHAIN = f"""
{_AT_OFFSETS},
s AS (SELECT off, pulse, az, rg, ph, {_lerp(1)} AS sr, {_lerp(2)} AS si FROM f),
film AS (SELECT off AS film, look, az, rg, sum(sr * cos(ph) - si * sin(ph)) AS re, sum(sr * sin(ph) + si * cos(ph)) AS im
  FROM s JOIN win ON pulse >= start AND pulse < start + per GROUP BY off, look, az, rg),
{_track_body("first", TILE, 0.0)},
ser AS (SELECT film * 100 + iaz AS win, look, quality, da AS v, 0.0 AS c FROM los)
"""
SWEEP_REALISATIONS = f"""
WITH {_psd("v", series=_OFFSET_CHAIN)}, {SCALES},
shape AS (SELECT m.r_ref AS slant, abs(l.px - f.px) AS aperture FROM np JOIN pl f ON f.pulse = 0 JOIN pl m ON m.pulse = n // 2 JOIN pl l ON l.pulse = n - 1),
pace AS (SELECT (b.start - a.start) / 100.0::DOUBLE AS dt, 75.0 / m.r_ref AS speed FROM win a JOIN win b ON a.look = 0 AND b.look = 1
  JOIN pl m ON m.pulse = a.start + a.per // 2),
asm AS (SELECT a.s * 100.0 AS velocity, b.s * 400.0 AS frequency, a.s * 100.0 / (2 * b.s * 400.0) AS lam FROM sc a, sc b),
ok AS (SELECT asm.*, lam * slant / (2 * aperture) AS res FROM asm, shape WHERE velocity >= 100 AND lam * slant / (2 * aperture) <= 5.0),
mp AS (SELECT win // 100 AS off, k, avg(psd * speed * speed * dt / 0.25) AS p FROM psd, pace GROUP BY ALL),
rs AS (SELECT velocity, frequency, k, floor(velocity * {N} * dt / (2 * k) / 5.0 + 0.5)::INT AS j FROM ok, pace, range(1, {N // 2 + 1}) f(k)
  WHERE velocity * {N} * dt / (2 * k) <= 60.0),
hit AS (SELECT off, velocity, frequency, j, avg(p) AS value FROM rs JOIN mp USING (k) GROUP BY ALL),
mean AS (SELECT x.off, o.velocity, o.frequency, r.j, coalesce(value, 0.0) AS m FROM (SELECT DISTINCT off FROM mp) x CROSS JOIN ok o CROSS JOIN range(13) r(j)
  LEFT JOIN hit h ON h.off = x.off AND h.velocity = o.velocity AND h.frequency = o.frequency AND h.j = r.j),
{_interpolated("off, velocity, frequency", 5.0)}
SELECT 0::BIGINT AS scene, off::BIGINT AS "offset", {_r("velocity", "velocity")}, {_r("frequency", "frequency")}, {_r("lam", "lambda_ac")},
  {_r("res", "resolution")}, {_r("peak_depth", "peak_depth")}, {_r("peak_value", "peak_value", 8)} FROM ip JOIN ok USING (velocity, frequency)
"""
ASSUMED = """
mg AS (SELECT l_returnflag AS scene, l_quantity * 0.01::DOUBLE AS lambda_ac, avg(l_quantity * (1 + l_tax) * sqrt(l_extendedprice)) AS pd,
    avg(l_discount) AS pv, stddev_pop(l_quantity * (1 + l_tax) * sqrt(l_extendedprice)) AS sd, count(*) AS n FROM lineitem GROUP BY 1, 2)
"""
MERGE = f"""
WITH {ASSUMED}
SELECT scene, {_r("lambda_ac", "lambda_ac")}, {_r("pd", "peak_depth")}, {_r("pv", "peak_value")}, {_r("sd", "sd")}, n AS n_rows FROM mg
"""
FIT = f"""
WITH {ASSUMED},
st AS (SELECT scene, count(*) AS n, regr_slope(ln(pd), ln(lambda_ac)) AS s, corr(ln(lambda_ac), ln(pd)) AS c FROM mg WHERE sd <= 0.45 * pd GROUP BY scene),
al AS (SELECT scene, count(*) AS n, regr_slope(ln(pd), ln(lambda_ac)) AS s, corr(ln(lambda_ac), ln(pd)) AS c FROM mg GROUP BY scene)
SELECT scene, al.n AS n_used, {_r("al.s", "slope")}, {_r("al.c", "correlation")}, st.n AS n_steady,
  {_r("st.s", "slope_steady")}, {_r("st.c", "corr_steady")} FROM al LEFT JOIN st USING (scene)
"""
SLICE = f"WITH {MODEL_A} SELECT win, {_r('depth', 'depth')}, {_r('value', 'value', 4)} FROM prof WHERE j = 15"
SECTION = f"""
WITH {MODEL_A},
ext AS (SELECT max(win // 15) AS na FROM wins),
ln AS (SELECT i AS sample, floor(i / 24.0::DOUBLE * na + 0.5)::BIGINT * 15 + floor(i / 24.0::DOUBLE * 14 + 0.5)::BIGINT AS win FROM ext, range(25) r(i))
SELECT sample, j::BIGINT AS j, {_r("depth", "depth")}, {_r("value", "value", 4)} FROM ln JOIN prof USING (win)
"""
GEOCODED = f"""
WITH {MODEL_A}, {ELLIPSOID},
pk AS (SELECT win, depth, value FROM prof WHERE j >= 1 QUALIFY row_number() OVER (PARTITION BY win ORDER BY value DESC, j) = 1),
off AS (SELECT win AS key, depth, (win // 15) * 16.0::DOUBLE - 40.0 AS px, (win % 15) * 16.0::DOUBLE - 120.0 AS py FROM pk WHERE value > 0),
pt AS (SELECT key, depth, {_plane_xyz("px", "py")} FROM off),
{_to_llh("pt", "back", "key, depth, x, y, z")}
SELECT key AS win, {_r("lat", "lat")}, {_r("lon", "lon")}, {_r("hae", "plane_hae", 3)}, {_r("depth", "peak_depth")},
  {_r("hae - depth", "peak_hae", 3)} FROM back
"""

# -- change, validation, display -----------------------------------------------------

CHANGE = f"""
WITH px AS (SELECT vec_id AS look, i // 4 AS az, i % 4 AS rg, embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im
  FROM embeddings, range(32) r(i)),
ld AS (SELECT avg(re * re + im * im) * 0.001::DOUBLE * 9 AS load FROM px),
pr AS (SELECT a.look, a.az, a.rg, a.re * a.re + a.im * a.im AS p0, b.re * b.re + b.im * b.im AS p1,
    a.re * b.re + a.im * b.im AS br, a.im * b.re - a.re * b.im AS bi
  FROM px a JOIN px b ON b.look = a.look + 1 AND b.az = a.az AND b.rg = a.rg),
bx AS (SELECT c.az, c.rg, p.look, sum(p0) AS a, sum(p1) AS d, sum(br) AS br, sum(bi) AS bi
  FROM (SELECT y.i AS az, x.i AS rg FROM range(1, 7) y(i), range(1, 3) x(i)) c
  JOIN pr p ON p.az BETWEEN c.az - 1 AND c.az + 1 AND p.rg BETWEEN c.rg - 1 AND c.rg + 1 GROUP BY c.az, c.rg, p.look),
tr AS (SELECT x.az, x.rg, x.a + load AS xa, x.d + load AS xd, x.br AS xr, x.bi AS xi, y.a + load AS ya, y.d + load AS yd, y.br AS yr, y.bi AS yi
  FROM bx x JOIN bx y ON y.look = x.look + 1 AND y.az = x.az AND y.rg = x.rg, ld),
ev AS (SELECT az, rg, (xa * yd + xd * ya - 2 * (xr * yr + xi * yi)) / (ya * yd - yr * yr - yi * yi) AS tr,
    (xa * xd - xr * xr - xi * xi) / (ya * yd - yr * yr - yi * yi) AS dt FROM tr),
rt AS (SELECT az, rg, (tr + sqrt(greatest(tr * tr - 4 * dt, 0))) / (tr - sqrt(greatest(tr * tr - 4 * dt, 0))) AS ratio FROM ev)
SELECT g.az::BIGINT AS az, g.rg::BIGINT AS rg, {_r("coalesce(s, 0.0)", "stat")}
FROM (SELECT y.i AS az, x.i AS rg FROM range(8) y(i), range(4) x(i)) g
LEFT JOIN (SELECT az, rg, avg(ratio) AS s FROM rt GROUP BY az, rg) USING (az, rg)
"""

REQUESTS = """
rq AS (SELECT o_orderkey, o_totalprice / 15000.0::DOUBLE AS dwell, o_custkey AS n_pulse, (o_custkey % 700)::DOUBLE AS over,
    (o_orderkey % 40) / 8.0::DOUBLE - 0.5 AS f, (o_orderkey % 7) / 1000.0::DOUBLE AS amp, (o_custkey % 17 + 1) / 200.0::DOUBLE AS alpha,
    (o_custkey % 10) / 10.0::DOUBLE AS ov, (o_orderkey % 9) / 20.0::DOUBLE AS gate FROM orders),
r1 AS (SELECT *, alpha * dwell AS ts, (1.0 / alpha - ov) / (1.0 - ov) AS looks, f * (alpha * dwell) AS eta,
    640000.0::DOUBLE * 2 * pi() * f * cos(0.61::DOUBLE) AS swing, 0.0305::DOUBLE * 640000.0 / (2.0 * 7410.0 * (alpha * dwell)) AS res FROM rq),
r2 AS (SELECT *, 1.0 / (2.0 * ts) AS fmax, floor(eta + 0.5) AS wh, 1.5 * res AS ceil_px,
    CASE WHEN swing > 0 THEN 3.5 * 7410.0 / swing ELSE 'inf'::DOUBLE END AS amin, floor(looks + 0.5)::BIGINT AS nl FROM r1),
r3 AS (SELECT *, CASE WHEN wh >= 1 THEN abs(eta - wh) ELSE eta END AS dist, greatest(32.0 / res, 1.0) * 32 AS ind,
    (SELECT sum((nl - d) * greatest(1.0 - d * (1.0 - ov), 0.0)) / sum(nl - d) FROM range(1, greatest(nl, 1)) q(d)) AS fl FROM r2),
fd AS (
  SELECT o_orderkey, 'metadata' AS "check", CASE WHEN dwell > 0 THEN 'PASS' ELSE 'FAIL' END AS level,
    floor((dwell)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((640.0)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((7410.0)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3 FROM r3
  UNION ALL SELECT o_orderkey, 'frequency_resolution', CASE WHEN f * dwell < 3 THEN 'FAIL' ELSE 'PASS' END,
    floor((1 / dwell)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((f * dwell)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, CAST(NULL AS DOUBLE) AS figure_3 FROM r3 WHERE dwell > 0 AND f > 0
  UNION ALL SELECT o_orderkey, 'observable_band', CASE WHEN f > 0 AND f >= fmax THEN 'FAIL' ELSE 'PASS' END,
    floor((fmax)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((0.5 / CASE WHEN looks > 1 THEN (dwell - ts) / (looks - 1) ELSE dwell END)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((looks)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3 FROM r3 WHERE dwell > 0
  UNION ALL SELECT o_orderkey, 'grid_width', CASE WHEN 128 < floor(2 * looks + 0.5) THEN 'FAIL' ELSE 'PASS' END,
    floor((floor(2 * looks + 0.5))::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((128)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, CAST(NULL AS DOUBLE) AS figure_3 FROM r3 WHERE dwell > 0
  UNION ALL SELECT o_orderkey, 'observation_ratio', CASE WHEN eta > 0.2 THEN 'WARN' ELSE 'PASS' END,
    floor((eta)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((0.2 / ts)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((ts)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3 FROM r3 WHERE dwell > 0 AND f > 0
  UNION ALL SELECT o_orderkey, 'averaging_null', CASE WHEN wh >= 1 AND dist < 0.1 THEN 'FAIL' WHEN wh >= 1 AND dist < 0.2 THEN 'WARN' ELSE 'PASS' END,
    floor((1 / ts)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((2 / ts)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((3 / ts)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3
    FROM r3 WHERE dwell > 0 AND f > 0
  UNION ALL SELECT o_orderkey, 'aperture_fraction', CASE WHEN alpha BETWEEN 0.045 AND 0.076 THEN 'PASS' ELSE 'WARN' END,
    floor((alpha)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((0.045)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((0.076)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3 FROM r3 WHERE dwell > 0
  UNION ALL SELECT o_orderkey, 'prf_stability', CASE WHEN 100.0 * over / 8800.0 > 5 THEN 'WARN' ELSE 'PASS' END,
    floor((100.0 * over / 8800.0)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((0.00097 * 8800.0)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, CAST(NULL AS DOUBLE) AS figure_3 FROM r3 WHERE dwell > 0
  UNION ALL SELECT o_orderkey, 'sensitivity', CASE WHEN amp <= 0 THEN 'UNKNOWN' WHEN amp / amin < 1 THEN 'FAIL' WHEN amp / amin < 3 THEN 'WARN' ELSE 'PASS' END,
    floor((amin)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((amp / amin)::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((2.449 / 40.0)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3
    FROM r3 WHERE dwell > 0 AND f > 0
  UNION ALL SELECT o_orderkey, 'ambiguity', CASE WHEN ceil_px <= 7 OR (amp > 0 AND NOT amp BETWEEN 3.5 / (swing / 7410.0) AND 0.5 * ceil_px / (swing / 7410.0))
    THEN 'FAIL' ELSE 'PASS' END,
    floor((ceil_px)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((3.5 / (swing / 7410.0))::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((0.5 * ceil_px / (swing / 7410.0))::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3 FROM r3 WHERE dwell > 0 AND f > 0
  UNION ALL SELECT o_orderkey, 'coherence_gate', CASE WHEN gate > 0 AND gate <= fl THEN 'FAIL' WHEN gate <= 1.5 * fl THEN 'WARN' ELSE 'PASS' END,
    floor((fl)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor(((SELECT sum(nl - d) FROM range(1, greatest(nl, 1)) q(d) WHERE d * (1.0 - ov) < 1.0) / (nl * (nl - 1) / 2.0))::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((gate)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3
    FROM r3 WHERE dwell > 0 AND ov > 0 AND nl > 1
  UNION ALL SELECT o_orderkey, 'phase_floor', CASE WHEN ind <= 4 THEN 'WARN' ELSE 'PASS' END,
    floor((ind)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, floor((sqrt(1 - gate * gate) / (gate * sqrt(2 * ind)))::DOUBLE * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS figure_2, floor((sqrt(1 - gate * gate) / (gate * sqrt(2 * ind)) * 0.0305 / (4 * pi()))::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_3 FROM r3 WHERE dwell > 0 AND gate > 0
  UNION ALL SELECT o_orderkey, 'memory', 'PASS',
    floor((n_pulse * 4096.0 * 8 / 1e9)::DOUBLE * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS figure_1, CAST(NULL AS DOUBLE) AS figure_2, CAST(NULL AS DOUBLE) AS figure_3 FROM r3 WHERE dwell > 0 AND n_pulse > 0
  UNION ALL SELECT o_orderkey, 'ground_truth', 'UNKNOWN',
    CAST(NULL AS DOUBLE) AS figure_1, CAST(NULL AS DOUBLE) AS figure_2, CAST(NULL AS DOUBLE) AS figure_3 FROM r3 WHERE dwell > 0)
"""
FINDINGS = f"WITH {REQUESTS} SELECT * FROM fd"
VERDICT = f"""
WITH {REQUESTS}
SELECT o_orderkey, CASE max(CASE level WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM fd GROUP BY o_orderkey
"""
PRI = f"""
WITH d AS (SELECT lead(epoch_us(ts) / 1000000.0::DOUBLE) OVER (ORDER BY event_id) - epoch_us(ts) / 1000000.0::DOUBLE AS pri FROM events),
k AS (SELECT pri, row_number() OVER (ORDER BY pri) - 1 AS i, count(*) OVER () AS n FROM d WHERE pri IS NOT NULL),
e AS (SELECT any_value(n) AS n, max(pri) FILTER (WHERE i = n // 100) AS p01, max(pri) FILTER (WHERE i = n * 99 // 100) AS p99, max(pri) AS worst FROM k)
SELECT n, {_r("p01", "pri_p01")}, {_r("p99", "pri_p99")}, {_r("worst", "worst_gap_s")}, {_r("1 / p99", "prf_min_hz")}, {_r("1 / p01", "prf_max_hz")} FROM e
"""
QUICKLOOK = f"""
WITH px AS (SELECT vec_id AS rg, i AS az, sqrt(embedding[2 * i + 1]::DOUBLE ** 2 + embedding[2 * i + 2]::DOUBLE ** 2) AS amp FROM embeddings, range(32) r(i)),
k AS (SELECT amp, row_number() OVER (ORDER BY amp) - 1 AS i, count(*) OVER () AS n FROM px),
w AS (SELECT max(amp) AS white FROM k WHERE i = floor((n - 1) * 0.99::DOUBLE))
SELECT az::BIGINT AS az, rg, CASE WHEN amp > 0 AND white > 0
  THEN floor(greatest(0.0, least(1.0, 1 + 20 * (log10(amp) - log10(white)) / 40.0)) * 255 + 0.5) ELSE 0 END::BIGINT AS level FROM px, w
"""


def _band(anchors: list[int]) -> str:
    table = "[" + ", ".join(f"{a}.0::DOUBLE" for a in anchors) + "]"
    i = "least(floor(s * 15), 14)::INT"
    return f"floor({table}[{i} + 1] + (s * 15 - {i}) * ({table}[{i} + 2] - {table}[{i} + 1]) + 0.5)::BIGINT"


def _frequency_map() -> str:
    bands = [_band([a[k] for a in PALETTES["energy"]]) for k in range(3)]
    colours = ", ".join(f"{b} AS {c}" for b, c in zip(bands, "rgb"))
    return f"""
WITH {SP}, rn AS (SELECT min(freq) AS lo, max(freq) AS hi FROM sp),
sh AS (SELECT win, greatest(0.0, least(1.0, (freq - lo) / (CASE WHEN hi <= lo THEN 1.0 ELSE hi - lo END))) AS s FROM sp, rn)
SELECT win, floor(s * 255 + 0.5)::BIGINT AS level, {colours} FROM sh
"""


CROP = f"""
WITH px AS (SELECT i AS az, embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im FROM embeddings, range(32) r(i))
SELECT (az - 8)::BIGINT AS az, count(*) AS n, {_r("avg(re)", "mre")}, {_r("avg(im)", "mim")} FROM px WHERE az BETWEEN 8 AND 23 GROUP BY az
"""
INFO = f"""
WITH {PULSES}
SELECT count(*) AS n_pulses, 32::BIGINT AS n_bins, {_r("max(t) - min(t)", "dwell")}, {_r("(count(*) - 1) / (max(t) - min(t))", "prf")},
  {_r("min(r_ref)", "near_ref")}, {_r("max(r_ref)", "far_ref")} FROM pl
"""

ORACLE: dict[str, str] = {
    "acoustic_wavelength": ACOUSTIC,
    "resolution_grid": RESOLUTION,
    "tomographic_wavenumber": WAVENUMBER,
    "feasibility": FEASIBILITY,
    "band_shape": BAND,
    "doppler_polynomial": POLYNOMIAL,
    "orbit_interp": ORBIT,
    "image_faults": FAULTS,
    "ecf_llh_roundtrip": ROUNDTRIP,
    "plane_offset": PLANE,
    "project_to_height": PROJECT,
    "slant_to_ground": SLANT,
    "azimuth_power": AZIMUTH_POWER,
    "doppler_centroid": CENTROID,
    "doppler_bandwidth": BANDWIDTH,
    "spectral_split": SPLIT,
    "paired_split": PAIRED,
    "sliding_subapertures": SLIDING,
    "depth_scales": DEPTH_SCALES,
    "conditioning": CONDITIONING,
    "orbit_asof": ORBIT_ASOF,
    "scene_places": SCENE_PLACES,
    "azimuth_resolutions": AZIMUTH_RESOLUTIONS,
    "collect_shape": COLLECT_SHAPE,
    "pulses_to_depth": PULSES_TO_DEPTH,
    "backproject": BACKPROJECT,
    "backproject_sinc": BACKPROJECT_SINC,
    "window_geometry": WINDOW_GEOMETRY,
    "pulses_to_spectrum": PULSES_TO_SPECTRUM,
    "track_first": _track("first"),
    "track_adjacent": _track("adjacent"),
    "track_lag": _track("lag"),
    "track_pair": _track("pair"),
    "shuffle_null": SHUFFLE_NULL,
    "track_splitband": SPLITBAND,
    "track_exhaustive": _track("first", exhaustive=True),
    "track_phase": PHASE,
    "patch_demean": DEMEAN,
    "reference_series": REFERENCE,
    "common_mode_removed": COMMON,
    "spectrum_psd": PSD,
    "window_spectrum": WINDOWS,
    "displacement_spectrum": DISPLACEMENT,
    "best_window": BEST,
    "consensus": CONSENSUS,
    "window_evidence": EVIDENCE,
    "largest_block": BLOCK,
    "eligible_blocks": ELIGIBLE,
    "selection_report": REPORT,
    "shift_statistics": STATISTICS,
    "strongest_windows": STRONGEST,
    "control_report": CONTROL,
    "model_a_profile": f"WITH {MODEL_A} {_CELLS}",
    "model_a_lstsq_profile": _least_squares(21, 0.001),
    "model_b_profile": MODEL_B,
    "model_c_profile": MODEL_C,
    "model_d_profile": MODEL_D,
    "window_peaks": PEAKS,
    "profile_peak": PROFILE_PEAK,
    "stack_contrast": CONTRAST,
    "alignment_null": ALIGNMENT,
    "sweep": SWEEP,
    "sweep_resonance": SWEEP_D,
    "sweep_realisations": SWEEP_REALISATIONS,
    "sweep_merge": MERGE,
    "sweep_fit": FIT,
    "depth_slice": SLICE,
    "depth_section": SECTION,
    "geocoded_peaks": GEOCODED,
    "change_map": CHANGE,
    "validate_findings": FINDINGS,
    "validate_verdict": VERDICT,
    "pri_percentiles": PRI,
    "quicklook": QUICKLOOK,
    "frequency_map": _frequency_map(),
    "crop": CROP,
    "collect_info": INFO,
}
