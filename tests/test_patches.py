import numpy as np
import pytest

from sarmotion.errors import ArgumentError, RangeFault
from sarmotion.operators import patches


def gaussian(da=0.0, dr=0.0, n=32):
    a, r = np.mgrid[:n, :n]
    return np.exp(-((a - 16 - da) ** 2 + (r - 16 - dr) ** 2) / 8.0).astype(complex)


@pytest.mark.parametrize("shift", [(0, 0), (1, 0), (0, 1), (2, -3), (-2, 2), (0.5, -0.25), (1.3, 0.7)])
@pytest.mark.parametrize("exhaustive", [False, True])
def test_shifts_are_recovered(shift, exhaustive):
    ref, img = (patches.demean(p[None]) for p in (gaussian(), gaussian(*shift)))
    az, rg, peak = patches.register(ref, img, 10, 20, exhaustive)
    assert abs(az[0] - shift[0]) <= 0.15 and abs(rg[0] - shift[1]) <= 0.15
    assert 0.9 < peak[0] <= 1.0


def test_identical_patches_peak_at_one():
    p = patches.demean(gaussian()[None])
    az, rg, peak = patches.register(p, p, 10, 20)
    assert (az[0], rg[0]) == (0, 0) and peak[0] == pytest.approx(1.0)


def test_silence_is_no_shift():
    flat = np.zeros((1, 8, 8), complex)
    assert [v[0] for v in patches.register(flat, flat, 4, 4)] == [0.0, 0.0, 0.0]


def test_surface_limit():
    patches.check_surface(64, 64, 10, 20)
    with pytest.raises(RangeFault):
        patches.check_surface(512, 512, 20, 20)


def test_phase_linking_recovers_phases():
    rng = np.random.default_rng(5)
    base = rng.normal(size=200) + 1j * rng.normal(size=200)
    truth = np.array([0.0, 0.4, -1.1, 2.0, -2.7])
    found, settled = patches.phase_link(np.exp(1j * truth)[:, None] * base)
    assert settled and np.abs(np.angle(np.exp(1j * (found - truth)))).max() < 1e-6
    # Two rows trade phases for ever, and that is told.
    assert not patches.phase_link(np.exp(1j * truth[:2])[:, None] * base)[1]


def test_occupied_band_grows_upwards_on_ties():
    assert patches.occupied_band(np.array([0, 1.0, 8, 1.0, 0])) == (2, 3)
    assert patches.occupied_band(np.zeros(5)) == (0, 4)


@pytest.mark.parametrize("shift", [0.1, -0.2, 0.35])
def test_splitband_measures_subpixel_shifts(shift):
    rng = np.random.default_rng(6)
    n = 48
    spectrum = np.fft.fft(rng.normal(size=(n, 16)) + 1j * rng.normal(size=(n, 16)), axis=0)
    f = np.fft.fftfreq(n)
    spectrum[np.abs(f) > 0.3] = 0
    looks = [
        np.fft.ifft(spectrum * np.exp(-2j * np.pi * f * k * shift)[:, None], axis=0) for k in range(4)
    ]
    found, coherence, settled = patches.splitband_shift(np.stack(looks))
    assert found == pytest.approx(shift * np.arange(4), abs=0.1)
    assert 0.5 < coherence <= 1.0


def test_splitband_refuses_what_it_cannot_split():
    with pytest.raises(ArgumentError):
        patches.splitband_shift(np.ones((2, 4, 4), complex))
    with pytest.raises(RangeFault):
        patches.splitband_shift(np.ones((2, 16, 4), complex))
