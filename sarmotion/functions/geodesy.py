"""Earth-fixed and geodetic coordinates on the WGS-84 ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..errors import MissingMetadata
from ..params import WGS84_A, WGS84_F, Plane
from .geometry import as_col

_B = WGS84_A * (1.0 - WGS84_F)
_E2 = WGS84_F * (2.0 - WGS84_F)
_EP2 = (WGS84_A**2 - _B**2) / _B**2
_DEG = 180.0 / math.pi


def ecf_to_llh(x, y, z) -> Column:
    """STRUCT<lat, lon, hae> in degrees and metres; NULL at the centre of the earth."""
    x, y, z = as_col(x), as_col(y), as_col(z)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_A, p * _B)
    lat = F.atan2(
        z + _EP2 * _B * F.pow(F.sin(theta), 3.0),
        p - _E2 * WGS84_A * F.pow(F.cos(theta), 3.0),
    )
    prime = WGS84_A / F.sqrt(1.0 - _E2 * F.sin(lat) * F.sin(lat))
    hae = F.when(F.abs(F.cos(lat)) > 1e-9, p / F.cos(lat) - prime).otherwise(
        F.abs(z) - _B
    )
    located = F.struct(
        (lat * _DEG).alias("lat"),
        (F.atan2(y, x) * _DEG).alias("lon"),
        hae.alias("hae"),
    )
    return F.when((p >= 1.0) | (F.abs(z) >= 1.0), located)


def llh_to_ecf(lat, lon, hae) -> Column:
    """STRUCT<x, y, z>; NULL when the latitude is outside [-90, 90]."""
    lat_deg, lon_deg, h = as_col(lat), as_col(lon), as_col(hae)
    phi, lam = lat_deg / _DEG, lon_deg / _DEG
    prime = WGS84_A / F.sqrt(1.0 - _E2 * F.sin(phi) * F.sin(phi))
    point = F.struct(
        ((prime + h) * F.cos(phi) * F.cos(lam)).alias("x"),
        ((prime + h) * F.cos(phi) * F.sin(lam)).alias("y"),
        ((prime * (1.0 - _E2) + h) * F.sin(phi)).alias("z"),
    )
    return F.when((lat_deg >= -90.0) & (lat_deg <= 90.0), point)


def _need(plane: Plane | None) -> Plane:
    if plane is None:
        raise MissingMetadata("this product carries no image plane")
    return plane


def plane_point(plane: Plane | None, x, y) -> Column:
    """Earth-fixed position of plane offsets ``x`` and ``y``."""
    plane = _need(plane)
    x, y = as_col(x), as_col(y)
    axes = zip("xyz", plane.origin, plane.u_x, plane.u_y)
    return F.struct(*[(o + x * a + y * b).alias(n) for n, o, a, b in axes])


def plane_llh(plane: Plane | None, x, y) -> Column:
    point = plane_point(plane, x, y)
    return ecf_to_llh(point["x"], point["y"], point["z"])


def plane_offset(plane: Plane | None, lat, lon, hae) -> Column:
    """STRUCT<x, y>: where a geodetic point falls on the plane's two axes."""
    plane = _need(plane)
    point = llh_to_ecf(lat, lon, hae)

    def along(axis):
        terms = [(point[n] - o) * a for n, o, a in zip("xyz", plane.origin, axis)]
        return terms[0] + terms[1] + terms[2]

    return F.struct(along(plane.u_x).alias("x"), along(plane.u_y).alias("y"))


def _height(p: np.ndarray) -> np.ndarray:
    """Ellipsoidal height of points stored along the last axis."""
    r = np.hypot(p[..., 0], p[..., 1])
    z = p[..., 2]
    theta = np.arctan2(z * WGS84_A, r * _B)
    lat = np.arctan2(
        z + _EP2 * _B * np.sin(theta) ** 3, r - _E2 * WGS84_A * np.cos(theta) ** 3
    )
    prime = WGS84_A / np.sqrt(1.0 - _E2 * np.sin(lat) ** 2)
    cos = np.cos(lat)
    safe = np.where(np.abs(cos) > 1e-9, cos, 1.0)
    return np.where(np.abs(cos) > 1e-9, r / safe - prime, np.abs(z) - _B)


def _bisect(height_at, lo, hi, target):
    """Vectorised bisection for height == target; NaN lanes stay NaN."""
    side = height_at(lo) - target
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        here = height_at(mid) - target
        crossed = side * here <= 0
        lo, hi = np.where(crossed, lo, mid), np.where(crossed, mid, hi)
        side = np.where(crossed, side, here)
    return 0.5 * (lo + hi)


_POINT = T.StructType([T.StructField(n, T.DoubleType()) for n in "xyz"])


def _frame(points: np.ndarray):
    return pd.DataFrame(points, columns=["x", "y", "z"])


def _xyz(pdf) -> np.ndarray:
    return pdf[["x", "y", "z"]].to_numpy(dtype=float)


@pandas_udf(_POINT)
def project_to_height(sensor: pd.DataFrame, point: pd.DataFrame, hae: pd.Series) -> pd.DataFrame:
    """Slide a point along its look ray to a height; NULL if the ray never reaches it."""
    s, p, target = _xyz(sensor), _xyz(point), hae.to_numpy(dtype=float)
    ray = p - s
    norm = np.linalg.norm(ray, axis=1)
    ray = ray / np.where(norm < 1.0, np.nan, norm)[:, None]
    at = lambda t: _height(s + t[:, None] * ray)
    lo, hi = np.zeros_like(norm), 2.0 * norm
    spans = (at(lo) - target) * (at(hi) - target) <= 0
    t = np.where(spans, _bisect(at, lo, hi, target), np.nan)
    return _frame(s + t[:, None] * ray)


_STEPS = 720
_EDGES = -np.pi + 2.0 * np.pi * np.arange(_STEPS + 1) / _STEPS
# From the slant point outwards, the lower angle first where two are as far.
_OUTWARDS = np.argsort(np.abs(0.5 * (_EDGES[:-1] + _EDGES[1:])), kind="stable")


def _nearest_crossing(above, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of ``rows`` the step of the circle nearest the slant point in which ``above`` changes sign, else -1.

    Steps are tried outwards, each for the rows that have none yet.
    """
    best = np.full(n, -1)
    heights: dict[int, np.ndarray] = {}  # at the edges of the steps being tried
    tried = np.zeros(_STEPS + 2, dtype=bool)
    tried[[0, -1]] = True  # there is nothing beyond the ends
    for step in _OUTWARDS:
        if not len(rows):
            break
        for edge in (step, step + 1):
            if edge not in heights:
                heights[edge] = above(np.full(len(rows), _EDGES[edge]), rows)
        crossed = heights[step] * heights[step + 1] <= 0
        best[rows[crossed]] = step
        tried[step + 1] = True
        rows = rows[~crossed]
        heights = {e: h[~crossed] for e, h in heights.items() if not (tried[e] and tried[e + 1])}
    return best


@pandas_udf(_POINT)
def slant_to_ground(sensor: pd.DataFrame, velocity: pd.DataFrame, slant: pd.DataFrame, hae: pd.Series) -> pd.DataFrame:
    """Move a slant-plane point round its range-Doppler circle to a height.

    Of the crossings, the one nearest the slant point wins; NULL if there is none
    or the circle degenerates.
    """
    s, v, p = _xyz(sensor), _xyz(velocity), _xyz(slant)
    target = hae.to_numpy(dtype=float)
    speed = np.linalg.norm(v, axis=1)
    unit = v / np.where(speed < 1.0, np.nan, speed)[:, None]
    look = p - s
    along = np.einsum("ij,ij->i", look, unit)
    centre = s + along[:, None] * unit
    radial = look - along[:, None] * unit
    radius = np.linalg.norm(radial, axis=1)
    e1 = radial / np.where(radius < 1.0, np.nan, radius)[:, None]
    e2 = np.cross(unit, e1)

    def at(phi, rows):
        arm = np.cos(phi)[:, None] * e1[rows] + np.sin(phi)[:, None] * e2[rows]
        return centre[rows] + radius[rows, None] * arm

    def above(phi, rows):
        return _height(at(phi, rows)) - target[rows]

    best = _nearest_crossing(above, np.flatnonzero(np.isfinite(centre + e1).all(axis=1) & np.isfinite(radius + target)), len(s))
    rows = np.flatnonzero(best >= 0)
    lo, hi = _EDGES[best[rows]], _EDGES[best[rows] + 1]
    out = np.full(s.shape, np.nan)
    out[rows] = at(_bisect(lambda phi: _height(at(phi, rows)), lo, hi, target[rows]), rows)
    return _frame(out)
