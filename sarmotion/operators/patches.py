"""Small dense kernels applied to the patches of one task."""

from __future__ import annotations

import numpy as np

from ..errors import ArgumentError, RangeFault

# Largest exhaustive search surface, and the phase-linking limits.
MAX_SURFACE = 1 << 24
LINK_ITERATIONS = 32
LINK_TOLERANCE = 1e-9
OCCUPIED_ENERGY = 0.90


def check_surface(n_az: int, n_rg: int, up_az: int, up_rg: int) -> None:
    """Refuse an exhaustive search whose surface would not fit a task."""
    if n_az <= 0 or n_rg <= 0:
        raise ArgumentError("patch dimensions must be positive")
    if n_az * max(up_az, 1) * n_rg * max(up_rg, 1) > MAX_SURFACE:
        raise RangeFault(
            f"exhaustive search over {n_az}x{n_rg} patches at {up_az}x{up_rg} exceeds "
            f"{MAX_SURFACE} samples; reduce the refinement or the window"
        )


def _signed(index: np.ndarray, n: int) -> np.ndarray:
    return np.where(index > n / 2.0, index - n, index).astype(float)


def _frequencies(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.where(k < n // 2, k, k - n).astype(float)


def demean(patches: np.ndarray) -> np.ndarray:
    return patches - patches.mean(axis=(-2, -1), keepdims=True)


def register(ref, img, up_az: int, up_rg: int, exhaustive: bool = False):
    """Shift of each ``img`` patch against its ``ref``: (azimuth, range, peak).

    The cross spectrum is evaluated on a fine lattice within one pixel of its
    integer peak, or everywhere when ``exhaustive``.  The first maximum wins.
    """
    up_az, up_rg = max(up_az, 1), max(up_rg, 1)
    count, n_az, n_rg = ref.shape
    fa, fb = np.fft.fft2(ref), np.fft.fft2(img)
    cross = np.conj(fa) * fb
    energy = lambda f: (np.abs(f) ** 2).sum(axis=(1, 2))
    norm = np.sqrt(energy(fa) * energy(fb))
    live = norm > 0
    if exhaustive:
        check_surface(n_az, n_rg, up_az, up_rg)
        pad_az, pad_rg = n_az * up_az, n_rg * up_rg
        rows = np.where(_frequencies(n_az) < 0, pad_az, 0) + _frequencies(n_az).astype(int)
        cols = np.where(_frequencies(n_rg) < 0, pad_rg, 0) + _frequencies(n_rg).astype(int)
        az, rg, top = np.zeros(count), np.zeros(count), np.zeros(count)
        for i in np.nonzero(live)[0]:
            surface = np.zeros((pad_az, pad_rg), np.complex128)
            surface[np.ix_(rows, cols)] = cross[i]
            size = np.abs(np.fft.ifft2(surface))
            best = int(size.argmax())
            az[i] = _signed(np.array(best // pad_rg), pad_az) / up_az
            rg[i] = _signed(np.array(best % pad_rg), pad_rg) / up_rg
            top[i] = size.flat[best] * pad_az * pad_rg
    else:
        coarse = np.abs(np.fft.ifft2(cross)).reshape(count, -1).argmax(axis=1)
        c_az, c_rg = _signed(coarse // n_rg, n_az), _signed(coarse % n_rg, n_rg)
        f_az, f_rg = _frequencies(n_az), _frequencies(n_rg)
        ramp = lambda shift, f, n: np.exp(2j * np.pi * np.multiply.outer(shift, f) / n)
        d_az = np.arange(-up_az, up_az + 1) / up_az
        d_rg = np.arange(-up_rg, up_rg + 1) / up_rg
        centred = cross * ramp(c_az, f_az, n_az)[:, :, None] * ramp(c_rg, f_rg, n_rg)[:, None, :]
        lattice = np.abs(ramp(d_az, f_az, n_az) @ centred @ ramp(d_rg, f_rg, n_rg).T)
        flat = lattice.reshape(count, -1)
        best = flat.argmax(axis=1)
        az = c_az + d_az[best // len(d_rg)]
        rg = c_rg + d_rg[best % len(d_rg)]
        top = flat[np.arange(count), best]
    peak = np.minimum(1.0, top / np.where(live, norm, 1.0))
    return np.where(live, az, 0.0), np.where(live, rg, 0.0), np.where(live, peak, 0.0)


def coherence_matrix(signals: np.ndarray) -> np.ndarray:
    """Normalised inner products of the rows; zero where a row has no energy."""
    gram = signals @ signals.conj().T
    energy = np.real(np.diag(gram))
    norm = np.sqrt(np.outer(energy, energy))
    return np.divide(gram, norm, out=np.zeros_like(gram), where=norm > 0)


def phase_link(signals: np.ndarray) -> tuple[np.ndarray, bool]:
    """One phase per row, referenced to row 0, consistent with every pair; and whether the iteration settled.

    The fixed-point iteration needs three rows or more; two merely trade phases.
    """
    gamma = coherence_matrix(signals)
    energy = (np.abs(signals) ** 2).sum(axis=1)
    off = gamma - np.diag(np.diag(gamma))
    x = np.ones(len(signals), np.complex128)
    settled = False
    for _ in range(LINK_ITERATIONS):
        pull = off @ x
        size = np.abs(pull)
        step = np.where(size > 0, pull / np.where(size > 0, size, 1.0), x)
        moved = np.abs(step - x).sum()
        x = step
        settled = moved < LINK_TOLERANCE
        if settled:
            break
    phase = np.angle(x * np.conj(x[0]))
    return np.where(energy > 0, phase, 0.0), bool(settled)


def occupied_band(power: np.ndarray) -> tuple[int, int]:
    """Smallest run of bins round the peak holding 90% of the energy; ties grow up."""
    total = power.sum()
    last = len(power) - 1
    if total <= 0:
        return 0, last
    lo = hi = int(power.argmax())
    held = power[lo]
    while held < OCCUPIED_ENERGY * total and (lo > 0 or hi < last):
        below = power[lo - 1] if lo > 0 else -1.0
        above = power[hi + 1] if hi < last else -1.0
        if above >= below:
            hi += 1
            held += power[hi]
        else:
            lo -= 1
            held += power[lo]
    return lo, hi


def splitband_shift(stack: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """Azimuth shift per look from the phase between band thirds, mean coherence, and whether both phases settled."""
    n_look, n_az, n_rg = stack.shape
    if n_look < 2 or n_az < 6 or n_rg == 0:
        raise ArgumentError("split-band tracking needs 2 looks and 6 azimuth lines")
    spectrum = np.fft.fftshift(np.fft.fft(stack, axis=1), axes=1)
    lo, hi = occupied_band((np.abs(spectrum) ** 2).sum(axis=(0, 2)))
    width = hi - lo + 1
    if width < 6:
        raise RangeFault(f"the occupied azimuth band is {width} bins, too narrow to split")
    third = width // 3

    def linked(first: int, stop: int) -> tuple[np.ndarray, bool]:
        kept = np.zeros_like(spectrum)
        kept[:, first:stop] = spectrum[:, first:stop]
        band = np.fft.ifft(np.fft.ifftshift(kept, axes=1), axis=1)
        return phase_link(band.reshape(n_look, -1))

    (upper, above), (lower, below) = linked(hi + 1 - third, hi + 1), linked(lo, lo + third)
    step = upper - lower
    wrapped = np.angle(np.exp(1j * step))
    shift = wrapped * (-3.0 / (4.0 * np.pi * width / n_az))
    shift[0] = 0.0
    gamma = np.abs(coherence_matrix(stack.reshape(n_look, -1)))
    pairs = gamma[np.triu_indices(n_look, 1)]
    energy = (np.abs(stack) ** 2).sum(axis=(1, 2))
    alive = np.outer(energy, energy)[np.triu_indices(n_look, 1)] > 0
    return shift, float(pairs[alive].mean()) if alive.any() else 0.0, above and below
