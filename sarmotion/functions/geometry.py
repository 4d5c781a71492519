"""Closed-form geometry as column expressions.

Arguments may be numbers, column names or columns.  Non-physical inputs give
0.0 rather than NULL, so a result can be tested with ``> 0``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CONVENTIONS

Operand = "Column | str | float | int"


def as_col(x) -> Column:
    """Numbers become literals, strings become column references."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def _guard(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(0.0))


def acoustic_wavelength(velocity, frequency, convention: str = "paper") -> Column:
    v, f = as_col(velocity), as_col(frequency)
    return _guard((v > 0) & (f > 0), v / (F.lit(CONVENTIONS[convention]) * f))


def orbital_aperture(v_platform, dwell) -> Column:
    v, t = as_col(v_platform), as_col(dwell)
    return _guard((v > 0) & (t > 0), v * t)


def depth_resolution(wavelength, slant_range, aperture) -> Column:
    lam, r, a = as_col(wavelength), as_col(slant_range), as_col(aperture)
    return _guard(a > 0, lam * r / (2.0 * a))


def azimuth_resolution(wavelength, slant_range, v_platform, t) -> Column:
    lam, r = as_col(wavelength), as_col(slant_range)
    denom = 2.0 * as_col(v_platform) * as_col(t)
    return _guard(denom > 0, lam * r / denom)


def vibration_fmax(n_sub, dwell) -> Column:
    n, t = as_col(n_sub), as_col(dwell)
    return _guard((n > 0) & (t > 0), n / (2.0 * t))


def vibration_fmax_overlap(t_sap, overlap) -> Column:
    t, ov = as_col(t_sap), as_col(overlap)
    return _guard((t > 0) & (ov >= 0) & (ov < 1), 1.0 / (2.0 * t * (1.0 - ov)))


def observation_ratio(t_sap, period) -> Column:
    t, p = as_col(t_sap), as_col(period)
    return _guard(p > 0, t / p)


def spectrum_observation_ratio(t_sap, frequency) -> Column:
    t, f = as_col(t_sap), as_col(frequency)
    return _guard(f > 0, t * f)


def wavenumber(baseline, wavelength, slant_range, incidence) -> Column:
    denom = as_col(wavelength) * as_col(slant_range) * F.sin(as_col(incidence))
    return _guard(denom != 0, 4.0 * math.pi * as_col(baseline) / denom)


def subaperture_response(t_sap, frequency) -> Column:
    """Amplitude left after averaging over one sub-aperture; 1.0 where undefined."""
    t, f = as_col(t_sap), as_col(frequency)
    x = math.pi * f * t
    defined = (t > 0) & (f > 0) & (F.abs(x) >= 1e-8)
    return F.when(defined, F.abs(F.sin(x) / x)).otherwise(F.lit(1.0))


def max_velocity(win_px, spacing, slant_range, v_platform) -> Column:
    w, s = as_col(win_px), as_col(spacing)
    r, v = as_col(slant_range), as_col(v_platform)
    ok = (w > 0) & (s > 0) & (r > 0) & (v > 0)
    return _guard(ok, 0.5 * w * s * v / r)


def recommend_looks(frequency, amplitude, dwell, wavelength, overlap) -> Column:
    """Looks needed to sample a vibration without phase wraps; 0 if undefined."""
    f, a = as_col(frequency), as_col(amplitude)
    t, lam, ov = as_col(dwell), as_col(wavelength), as_col(overlap)
    ok = (f > 0) & (a > 0) & (t > 0) & (lam > 0) & (ov >= 0) & (ov < 1)
    need = (4.0 * math.pi / 0.75) * f * a * t / lam
    n = 1.0 + (need - 1.0) / (1.0 - ov)
    looks = F.when(n > 1, F.ceil(n)).otherwise(F.lit(2))
    return F.when(ok, looks).otherwise(F.lit(0)).cast("bigint")


def doppler_polynomial(coefficients, tau, tau_ref) -> Column:
    """Polynomial in ``tau - tau_ref``; ``coefficients`` is an array, lowest order first."""
    coeff = as_col(coefficients)
    dt = as_col(tau) - as_col(tau_ref)
    return F.aggregate(F.reverse(coeff), F.lit(0.0), lambda acc, c: acc * dt + c)


def raised_cosine(f, centre, width, roll) -> Column:
    """Band edge: flat top, cosine roll-off over ``roll``, zero outside."""
    d = F.abs(as_col(f) - as_col(centre))
    half, r = 0.5 * as_col(width), as_col(roll)
    flat = half - r
    return (
        F.when(d <= flat, F.lit(1.0))
        .when((d >= half) | (r <= 0), F.lit(0.0))
        .otherwise(0.5 * (1.0 + F.cos(math.pi * (d - flat) / r)))
    )


def bin_frequency(k, n, fs) -> Column:
    """Frequency of bin ``k`` of a centred spectrum of length ``n``."""
    nn = as_col(n)
    return (as_col(k) - F.floor(nn / 2.0)) * as_col(fs) / nn


def wrap_phase(phase) -> Column:
    """Fold an angle into (-pi, pi]."""
    p = as_col(phase)
    return F.atan2(F.sin(p), F.cos(p))


def validate_floor_px(upsample) -> Column:
    u = as_col(upsample)
    return F.when(u > 0, F.lit(2.449) / u).otherwise(F.lit(1.0))


def image_faults(
    fs_az, wavelength, az_spacing, rg_spacing, incidence, v_platform
) -> Column:
    """Name of the first implausible image field, or NULL when all pass."""
    fs, lam = as_col(fs_az), as_col(wavelength)
    az, rg = as_col(az_spacing), as_col(rg_spacing)
    inc, v = as_col(incidence), as_col(v_platform)
    ratio = v / az / fs
    sane = lambda s: (F.abs(s) >= 0.01) & (F.abs(s) <= 1000.0)
    mismatch = (v > 0) & (az > 0) & (fs > 0) & ((ratio > 1.5) | (ratio < 1.0 / 1.5))
    return (
        F.when(~((fs >= 1.0) & (fs <= 1e5)), "fs_az")
        .when(~((lam >= 0.001) & (lam <= 1.0)), "wavelength")
        .when((az != 0) & ~sane(az), "az_spacing")
        .when((rg != 0) & ~sane(rg), "rg_spacing")
        .when((inc != 0) & ~((inc > 0) & (inc < math.pi / 2)), "incidence")
        .when(mismatch, "line_rate")
    )
