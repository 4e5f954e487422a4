"""Validated, immutable parameter records. A dict is accepted in their place; unknown fields are errors."""

from __future__ import annotations

from dataclasses import dataclass, fields


class Control:
    """Base: construction from a dict or another control."""

    @classmethod
    def of(cls, value=None):
        if value is None:
            return cls()
        if isinstance(value, cls):
            return value
        unknown = set(value) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown fields of {cls.__name__}: {sorted(unknown)}")
        return cls(**value)


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Smoothing(Control):
    static_s: float = 3.0
    dba_s: float | None = None
    orientation_s: float | None = 1.0
    depth_s: float | None = 10.0
    velocity_s: float | None = 1.0

    def __post_init__(self):
        _check(self.static_s > 0, "static_s must be positive")


@dataclass(frozen=True)
class Calibration(Control):
    pitch_offset: bool = True
    roll_offset: bool = True
    min_r2: float = 0.1
    max_pitch_offset: float = 45.0
    max_roll_offset: float = 60.0
    least_rows: int = 100
    velocity_s: float = 10.0


@dataclass(frozen=True)
class Orientation(Control):
    algorithm: str = "tilt_compass"
    beta: float = 0.1
    max_pitch: float = 89.5

    def __post_init__(self):
        _check(self.algorithm in ("tilt_compass", "madgwick"), "unknown algorithm")


@dataclass(frozen=True)
class MagCalibration(Control):
    min_points: int = 100
    max_condition: float = 25.0
    min_coverage: float = 0.3


@dataclass(frozen=True)
class Anomaly(Control):
    """Limits of one channel for the quality check."""

    max_rate: float = 1.0
    resolution: float = 0.0
    stall_s: float = 300.0
    outlier_window_s: float = 300.0
    isolated: int = 0

    def __post_init__(self):
        _check(self.max_rate > 0, "max_rate must be positive")


@dataclass(frozen=True)
class DepthDrift(Control):
    min_dry_s: float = 3.0
    band: float = 2.0
    min_anchors: int = 3
    max_gap_s: float = 21_600.0


@dataclass(frozen=True)
class Alignment(Control):
    max_lag_s: int = 300
    coarse_s: int = 10
    min_corr: float = 0.9
    grid_s: int = 2
    min_overlap_s: float = 1800.0
    min_sd: float = 0.5


@dataclass(frozen=True)
class Integrity(Control):
    duplicate_corr: float = 0.999
    dead_range: float = 1e-9
    saturation: tuple[float, float] = (0.01, 0.20)
    mag_cv: float = 0.40
    accel_scale: tuple[float, float] = (0.2, 0.5)
    dropout: float = 0.5
    mag_break_auc: float = 0.96
    mag_break_step: float = 0.05
    mag_break_windows: int = 30


@dataclass(frozen=True)
class TrackMetrics(Control):
    min_points: int = 3


@dataclass(frozen=True)
class FilterLocations(Control):
    max_speed_kmh: float = 10.0
    max_distance_km: float = 500.0
    min_satellites: int = 4
    spike_angle: float | None = None
    max_iterations: int = 50
    removable: tuple[str, ...] = ("FastGPS", "Argos")


@dataclass(frozen=True)
class Reckoning(Control):
    speed: str = "constant"
    constant: float = 0.5
    max_speed: float = 2.5
    min_pitch: float = 45.0
    vedba_slope: float = 1.0
    vedba_intercept: float = 0.0
    rest_quantile: float | None = None
    correction: str = "error_weighted"
    weighting: str = "distance"
    default_radius_m: float = 1500.0
    drift_rate: float = 0.5
    diffusion: float = 0.0
    least_directedness: float = 0.1

    def __post_init__(self):
        _check(self.speed in ("constant", "paddle", "depth_rate", "vedba"), "unknown speed source")
        _check(self.correction in ("none", "linear", "error_weighted", "scale_rotate"), "unknown correction")
        _check(self.weighting in ("distance", "time"), "unknown weighting")


@dataclass(frozen=True)
class Dives(Control):
    threshold: float | None = None
    band: float | None = None
    min_amplitude: float | None = None
    min_duration_s: float | None = None
    max_gap_s: float | None = None
    wiggle: float | None = None
    prominence: float | None = None
    reference: str = "auto"
    direction: str = "down"
    phase_method: str = "vertical_rate"
    rate_quantile: float = 0.9
    rate_share: float = 0.25
    bottom_share: float = 0.8
    baseline_hours: float = 3.0

    def __post_init__(self):
        _check(self.phase_method in ("vertical_rate", "prop_depth"), "unknown phase method")
        _check(self.reference in ("auto", "surface", "baseline"), "unknown reference")
        _check(self.direction in ("down", "up", "both"), "unknown direction")


@dataclass(frozen=True)
class TailBeats(Control):
    min_hz: float = 0.1
    max_hz: float = 3.0
    window_s: float = 30.0
    min_periodicity: float = 0.15
    min_swim_s: float = 2.0
    ridge_prominence: float = 2.0
