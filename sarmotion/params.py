"""Parameter records.  Every default that affects a result is stated here."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Fixed physical values.
SPEED_OF_LIGHT = 299792458.0
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563

# Three standard deviations of a uniform quantisation error, peak to peak.
QUANT_FLOOR_SIGMA = 2.449

# A wavelength convention is named by the divisor it applies to v/f.
CONVENTIONS = {"paper": 2.0, "patent": 1.0}


@dataclass(frozen=True)
class Plane:
    """Image plane in earth-fixed coordinates; ``u_x`` and ``u_y`` are unit vectors."""

    origin: tuple[float, float, float]
    u_x: tuple[float, float, float]
    u_y: tuple[float, float, float]
    ref_hae: float = 0.0
    is_slant: bool = False
    sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)
    sensor_vel: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Grid:
    """Ground grid; x is along track (image azimuth), y is across (image range)."""

    n_x: int
    n_y: int
    dx: float = 1.0
    dy: float = 1.0
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    height: float = 0.0


@dataclass(frozen=True)
class CollectMeta:
    """One collect's scalars; the pulses themselves stay in a DataFrame."""

    n_pulse: int
    n_rbin: int
    dr: float
    fc: float
    wavelength: float
    prf: float
    r_near: float = 0.0
    phase_ref_srp: bool = False
    plane: Plane | None = None
    source: str = ""


@dataclass(frozen=True)
class ImageMeta:
    """Geometry and timing one complex image carries."""

    n_az: int
    n_rg: int
    fs_az: float = 0.0
    azimuth_time_interval: float = 0.0
    fc: float = 0.0
    wavelength: float = 0.0
    az_spacing: float = 0.0
    rg_spacing: float = 0.0
    r0: float = 0.0
    t0: float = 0.0
    t_dwell: float = 0.0
    incidence: float = 0.0
    v_platform: float = 0.0
    pulse_prf: float = 0.0
    plane: Plane | None = None
    source: str = ""


@dataclass(frozen=True)
class SubapParams:
    mode: str = "uniform"  # uniform | paper
    n_looks: int = 16
    overlap: float = 0.40
    left_out_frac: float = 0.5
    window: bool = True
    b_shift_hz: float = 0.0
    pair: bool = False
    range_taps: int = 0


@dataclass(frozen=True)
class StackMeta:
    """What one stack of sub-aperture images has in common."""

    n_looks: int
    image: ImageMeta
    dt: float
    f_max: float
    t_sap: float
    az_resolution: float = 0.0
    doppler_centroid: float = 0.0
    doppler_bandwidth: float = 0.0
    b_shift_hz: float = 0.0
    pair_lag_s: float = 0.0
    has_slave: bool = False
    centre_times: tuple[float, ...] = ()


@dataclass(frozen=True)
class TrackParams:
    estimator: str = "correlation"  # correlation | phase | splitband
    reference: str = "first"  # first | adjacent | lag | pair
    ref_lag: int = 1
    win_az: int = 64
    win_rg: int = 64
    stride_az: int = 16
    stride_rg: int = 16
    upsample_az: int = 10
    upsample_rg: int = 20
    coherence_min: float = 0.4
    remove_common_mode: bool = False
    exhaustive: bool = False
    # Physical layout only; neither changes a result.
    block_windows: int = 8
    looks_per_task: int = 32


@dataclass(frozen=True)
class MotionMeta:
    n_looks: int
    dt: float
    n_win_az: int
    n_win_rg: int
    f_max: float = 0.0
    t_sap: float = 0.0
    az_spacing: float = 1.0
    rg_spacing: float = 1.0
    quant_px: float = 0.0

    @property
    def n_win(self) -> int:
        return self.n_win_az * self.n_win_rg

    @property
    def df(self) -> float:
        return 1.0 / (self.dt * self.n_looks)


@dataclass(frozen=True)
class TomoParams:
    model: str = "A"  # A steering matrix | B standing wave | C baselines | D resonance
    solver: str = "dft"  # dft | lstsq
    y_source: str = "shifts"  # shifts | los
    convention: str = "paper"
    velocity: float = 0.0
    frequency: float = 0.0
    depth_max: float = 60.0
    depth_cell: float = 1.0
    slant_range: float = 500000.0
    incidence: float = 35.0 * math.pi / 180.0
    aperture: float = 75000.0
    radar_wavelength: float = 0.031
    regularisation: float = 1e-3
    eq22_literal_t: float = 0.0
    window: bool = True
    remove_y_mean: bool = True
    patent_exact: bool = False
    subap_window: bool = True
    coherence_min: float = 0.0
    pair_reference: bool = False
    provenance: str = ""


@dataclass(frozen=True)
class CcdParams:
    win: int = 5
    loading: float = 1e-3
    statistic: str = "g12"
    # Physical layout only; neither changes a result.
    tile: int = 256
    looks_per_task: int = 32


@dataclass(frozen=True)
class ValidateDefaults:
    alpha: float = 0.05
    overlap: float = 0.40
    upsample: int = 40
    cell_m: float = 1.0
    grid_n: int = 512
    win: int = 32
    coherence_min: float = 0.40


@dataclass(frozen=True)
class Target:
    """A point scatterer; vibration is vertical, ``amp*sin(2*pi*freq*t+phase)``."""

    x: float
    y: float
    z: float = 0.0
    rcs: float = 1.0
    vib_freq: float = 0.0
    vib_amp: float = 0.0
    vib_phase: float = 0.0
    phase: float = field(default=0.0)
