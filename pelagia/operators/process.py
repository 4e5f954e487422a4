"""The pivot: from calibrated raw channels to orientation, activity, vertical speed, and a reduced record.

Stages that are expressions share one window specification per record. Zero-phase filters and the
attitude filter are sequential over a record; they run in one kernel per ID over sorted Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.control import Calibration, DepthDrift, Orientation, Smoothing
from pelagia.functions import signal
from pelagia.functions.angles import over_frame, wrap180, wrap360
from pelagia.grouped import numbers, over_sorted_groups
from pelagia.operators.aggregates import time_bins
from pelagia.operators.tag import seconds
from pelagia.operators.windows import central_rate, interpolate, mean_over_seconds, reverse, seconds_frame, spec, turning, with_rate
from pelagia.runtime import cut

#: Decimals that each kind of column is stored with.
DECIMALS = {"ax": 4, "ay": 4, "az": 4, "gx": 4, "gy": 4, "gz": 4, "mx": 2, "my": 2, "mz": 2, "depth": 2, "temp": 2, "pitch": 2, "roll": 2, "heading": 2, "vedba": 4, "odba": 4, "vertical_velocity": 3, "turning_angle": 2, "paddle_freq": 4, "paddle_speed": 3, "accel": 4, "surge": 4, "sway": 4, "heave": 4, "jerk": 4}


def magnitude(prefix: str = "a") -> Column:
    return F.sqrt(sum((F.col(prefix + a) ** 2 for a in "xyz"), F.lit(0.0)))


def tilt(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pitch and roll in degrees of a static acceleration."""
    return F.degrees(F.atan2(-x, F.sqrt(y * y + z * z))), F.degrees(F.atan2(y, z))


def heading(pitch: Column, roll: Column, mx: Column, my: Column, mz: Column, declination: Column | float = 0.0, max_pitch: float = 89.5) -> Column:
    """Tilt-compensated heading in [0, 360) plus declination; NULL near the vertical."""
    p, r = F.radians(pitch), F.radians(roll)
    x = mx * F.cos(p) + my * F.sin(p) * F.sin(r) + mz * F.sin(p) * F.cos(r)
    y = my * F.cos(r) - mz * F.sin(r)
    d = declination if isinstance(declination, Column) else F.lit(declination)
    return F.when(F.abs(pitch) <= max_pitch, wrap360(F.degrees(F.atan2(-y, x)) + d))


def apply_mag_calibration(data: DataFrame, calibration: DataFrame) -> DataFrame:
    """Axes minus centre, times the soft-iron matrix (``ID, cx, cy, cz, s11..s33``); IDs without one stay raw."""
    met = data.join(calibration, "ID", "left")
    c = [F.col(m) - F.col(o) for m, o in (("mx", "cx"), ("my", "cy"), ("mz", "cz"))]
    new = {m: F.coalesce(sum((F.col(f"s{i}{k + 1}") * c[k] for k in range(3)), F.lit(0.0)), F.col(m)) for i, m in enumerate(("mx", "my", "mz"), 1)}
    return met.select(*[new[x].alias(x) if x in new else F.col(x) for x in data.columns])


def apply_axis_mapping(data: DataFrame, nets: DataFrame) -> DataFrame:
    """Axes of each family multiplied by its signed permutation (``ID, family, m`` with m an array of 9).

    Families without a row stay; families of which a channel is missing in the table are skipped. A missing
    gyroscope matrix is made from the accelerometer's (determinant times matrix, rotation rates being axial).
    """
    wide = nets.groupBy("ID").agg(*[F.max(F.when(F.col("family") == f, F.col("m"))).alias(f"__{f}") for f in ("accel", "gyro", "mag")])

    def cell(f: str, k: int) -> Column:
        return F.get(f"__{f}", F.lit(k)).cast("double")

    a = [cell("accel", k) for k in range(9)]
    det = a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])
    met = data.join(wide, "ID", "left")
    new = {}
    for f, p in (("accel", "a"), ("gyro", "g"), ("mag", "m")):
        axes = [p + x for x in "xyz"]
        if not set(axes) <= set(data.columns):
            continue
        for r, axis in enumerate(axes):
            weight = [F.coalesce(cell(f, 3 * r + k), det * a[3 * r + k]) if f == "gyro" else cell(f, 3 * r + k) for k in range(3)]
            # A zero weight must not let a missing axis through.
            total = sum((F.when(weight[k] == 0, 0.0).otherwise(weight[k] * F.col(axes[k])) for k in range(3)), F.lit(0.0))
            new[axis] = F.when(weight[0].isNull(), F.col(axis)).otherwise(total)
    return met.select(*[new[x].alias(x) if x in new else F.col(x) for x in data.columns])


def split_acceleration(data: DataFrame, window_s: float = 3.0, dba_s: float | None = None) -> DataFrame:
    """`data` with static (``sx, sy, sz``) and dynamic (``surge, sway, heave``) acceleration, vedba and odba.

    Dynamic acceleration is a zero-phase two-pole high pass whose two passes together are 3 dB down at the corner
    that belongs to a running mean of `window_s`; static is the rest. Gaps split the record; runs too short
    for the filter are NULL.
    """
    names = ["surge", "sway", "heave", "sx", "sy", "sz", "vedba", "odba"]
    schema = ", ".join(f"{c} {t}" for c, t in data.dtypes) + ", " + ", ".join(f"{n} double" for n in names)

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        n = len(table)
        t = table.column("datetime").cast(pa.int64()).to_numpy() / 1e6
        raw = [numbers(table, c).astype(float) for c in ("ax", "ay", "az")]
        out = {k: np.full(n, np.nan) for k in names}
        for a, b in zip(starts.tolist(), np.r_[starts[1:], n].tolist()):
            dt = np.median(np.diff(t[a:b])) if b - a > 2 else np.nan
            if not np.isfinite(dt) or dt <= 0:
                continue
            fs = 1 / dt
            cut = signal.both_pass_corner(0.4430 / window_s, 2, "high")
            if cut >= fs / 2:
                continue
            for x, dyn, sta in zip(raw, ("surge", "sway", "heave"), ("sx", "sy", "sz")):
                out[dyn][a:b] = signal.filter_runs(x[a:b], fs, cut, "high")
                out[sta][a:b] = x[a:b] - out[dyn][a:b]
            out["vedba"][a:b] = np.sqrt(sum(out[k][a:b] ** 2 for k in ("surge", "sway", "heave")))
            out["odba"][a:b] = sum(np.abs(out[k][a:b]) for k in ("surge", "sway", "heave"))
            if dba_s and 0.4430 / dba_s < fs / 2:
                for k in ("vedba", "odba"):
                    out[k][a:b] = np.maximum(signal.filter_runs(out[k][a:b], fs, signal.both_pass_corner(0.4430 / dba_s), "low"), 0)
        for k in names:
            table = table.append_column(k, pa.array(out[k], from_pandas=True))
        return table

    return over_sorted_groups(data, ["ID"], ["datetime"], kernel, schema)


def attitude(data: DataFrame, beta: float = 0.1) -> DataFrame:
    """`data` with ``pitch, roll, heading`` of a gradient-descent attitude filter (gyro with accelerometer, and with
    magnetometer where there is one; heading is NULL without). Sequential over a record."""
    schema = ", ".join(f"{c} {t}" for c, t in data.dtypes) + ", pitch double, roll double, heading double"
    has_mag = {"mx", "my", "mz"} <= set(data.columns)

    def run_one(t, acc, gyr, mag):
        n = len(t)
        out = np.full((n, 3), np.nan)
        dt = np.diff(t, prepend=t[0])
        usual = float(np.median(dt[1:])) if n > 1 else 1.0
        q = None
        for i in range(n):
            a, g, m = acc[i], gyr[i], mag[i] if mag is not None else None
            if not np.all(np.isfinite(a)) or np.linalg.norm(a) == 0:
                continue
            a = a / np.linalg.norm(a)
            use = m is not None and np.all(np.isfinite(m)) and np.linalg.norm(m) > 0
            if q is None:  # seed from tilt (and compass)
                roll, pitch, yaw = np.arctan2(a[1], a[2]), np.arctan2(-a[0], np.hypot(a[1], a[2])), 0.0
                if use:
                    x = m[0] * np.cos(pitch) + m[1] * np.sin(pitch) * np.sin(roll) + m[2] * np.sin(pitch) * np.cos(roll)
                    yaw = np.arctan2(-(m[1] * np.cos(roll) - m[2] * np.sin(roll)), x)
                c, s = np.cos(np.array([roll, pitch, yaw]) / 2), np.sin(np.array([roll, pitch, yaw]) / 2)
                q = np.array([c[0] * c[1] * c[2] + s[0] * s[1] * s[2], s[0] * c[1] * c[2] - c[0] * s[1] * s[2], c[0] * s[1] * c[2] + s[0] * c[1] * s[2], c[0] * c[1] * s[2] - s[0] * s[1] * c[2]])
            else:
                w, x, y, z = q
                f = [2 * (x * z - w * y) - a[0], 2 * (w * x + y * z) - a[1], 2 * (0.5 - x * x - y * y) - a[2]]
                j = [[-2 * y, 2 * z, -2 * w, 2 * x], [2 * x, 2 * w, 2 * z, 2 * y], [0, -4 * x, -4 * y, 0]]
                if use:
                    m = m / np.linalg.norm(m)
                    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
                    h = r @ m
                    bx, bz = np.hypot(h[0], h[1]), h[2]
                    f += [2 * bx * (0.5 - y * y - z * z) + 2 * bz * (x * z - w * y) - m[0], 2 * bx * (x * y - w * z) + 2 * bz * (w * x + y * z) - m[1], 2 * bx * (w * y + x * z) + 2 * bz * (0.5 - x * x - y * y) - m[2]]
                    j += [[-2 * bz * y, 2 * bz * z, -4 * bx * y - 2 * bz * w, -4 * bx * z + 2 * bz * x], [-2 * bx * z + 2 * bz * x, 2 * bx * y + 2 * bz * w, 2 * bx * x + 2 * bz * z, -2 * bx * w + 2 * bz * y], [2 * bx * y, 2 * bx * z - 4 * bz * x, 2 * bx * w - 4 * bz * y, 2 * bx * x]]
                grad = np.asarray(j, float).T @ np.asarray(f, float)
                size = np.linalg.norm(grad)
                gy = np.where(np.isfinite(g), g, 0.0)
                rate = 0.5 * np.array([-x * gy[0] - y * gy[1] - z * gy[2], w * gy[0] + y * gy[2] - z * gy[1], w * gy[1] - x * gy[2] + z * gy[0], w * gy[2] + x * gy[1] - y * gy[0]])
                step = dt[i] if dt[i] > 0 else usual
                q = q + (rate - (beta * grad / size if size > 0 else 0)) * step
                q = q / np.linalg.norm(q)
            w, x, y, z = q
            out[i, 0] = np.degrees(np.arcsin(np.clip(2 * (w * y - z * x), -1, 1)))
            out[i, 1] = np.degrees(np.arctan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))
            if mag is not None:
                out[i, 2] = np.degrees(np.arctan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))) % 360
        return out

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = table.column("datetime").cast(pa.int64()).to_numpy() / 1e6
        acc, gyr = (np.column_stack([numbers(table, p + a).astype(float) for a in "xyz"]) for p in "ag")
        mag = np.column_stack([numbers(table, "m" + a).astype(float) for a in "xyz"]) if has_mag else None
        out = np.concatenate([run_one(t[a:b], acc[a:b], gyr[a:b], mag[a:b] if has_mag else None) for a, b in zip(starts.tolist(), np.r_[starts[1:], len(t)].tolist())]) if len(t) else np.zeros((0, 3))
        for k, name in enumerate(("pitch", "roll", "heading")):
            table = table.append_column(name, pa.array(out[:, k], from_pandas=True))
        return table

    return over_sorted_groups(data, ["ID"], ["datetime"], kernel, schema)


def vertical_velocity(data: DataFrame, smoothing: Smoothing | dict | None = None) -> DataFrame:
    """`data` with `vertical_velocity` (positive down): the central difference of depth averaged over `depth_s`, itself
    averaged over `velocity_s`. Depth stays as it is."""
    s, had = Smoothing.of(smoothing), "__us" in data.columns
    df = data if had else with_rate(data)
    df = df.withColumn("__z", mean_over_seconds(F.col("depth"), s.depth_s))
    df = df.withColumn("vertical_velocity", 1e6 * central_rate(F.col("__z"), F.col("__us"), spec(order=("__us",))))
    df = df.withColumn("vertical_velocity", mean_over_seconds(F.col("vertical_velocity"), s.velocity_s)).drop("__z")
    return df if had else df.drop("__us", "__rate")


def mount_offsets(data: DataFrame, control: Calibration | dict | None = None) -> DataFrame:
    """Per ID the pitch offset (intercept of pitch on vertical velocity) and the roll offset (median roll while the
    animal hardly moves vertically), both on the velocity averaged over `velocity_s`; 0 where the evidence is too thin."""
    c = Calibration.of(control)
    df = data if "__us" in data.columns else with_rate(data)
    data = df.withColumn("vertical_velocity", mean_over_seconds(F.col("vertical_velocity"), c.velocity_s)).select("ID", "pitch", "roll", "vertical_velocity")
    both = F.col("pitch").isNotNull() & F.col("vertical_velocity").isNotNull()
    p, v = F.when(both, F.col("pitch")), F.when(both, F.col("vertical_velocity"))
    fit = data.groupBy("ID").agg(F.count(p).alias("n"), F.stddev_samp(v).alias("sd"), F.regr_intercept(p, v).alias("b"), F.regr_r2(p, v).alias("r2"), F.percentile(F.abs("vertical_velocity"), 0.5).alias("still"))
    roll = data.join(fit.select("ID", "still"), "ID").where(F.abs("vertical_velocity") <= F.col("still")).groupBy("ID").agg(F.percentile("roll", 0.5).alias("r"))
    ok = (F.col("n") >= c.least_rows) & (F.col("sd") >= 1e-6) & (F.col("r2") >= c.min_r2) & (F.abs("b") < c.max_pitch_offset)
    return fit.join(roll, "ID", "left").select("ID", F.when(ok & F.lit(c.pitch_offset), F.col("b")).otherwise(0.0).alias("pitch_offset"), F.when((F.abs("r") < c.max_roll_offset) & F.lit(c.roll_offset), F.col("r")).otherwise(0.0).alias("roll_offset"))


def with_jerk(data: DataFrame) -> DataFrame:
    """`data` with `jerk`: the size of the change of acceleration since the row before, per second."""
    w = spec()
    dt = seconds() - F.lag(seconds()).over(w)
    change = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("ax", "ay", "az")), F.lit(0.0)))
    return data.withColumn("jerk", F.try_divide(change, F.nullif(dt, F.lit(0.0))))


def with_burst(data: DataFrame, limits: DataFrame) -> DataFrame:
    """`data` with `burst`: vedba is at or over the record's limit (``ID, burst_limit``); false without vedba."""
    return data.join(limits.select("ID", "burst_limit"), "ID", "left").withColumn("burst", F.coalesce(F.col("vedba") >= F.col("burst_limit"), F.lit(False))).drop("burst_limit")


def burst_limits(data: DataFrame, quantile: float = 0.95) -> DataFrame:
    """``ID, burst_limit``: the quantile of each record's vedba."""
    return data.groupBy("ID").agg(F.percentile("vedba", quantile).alias("burst_limit"))


def without_offsets(data: DataFrame, offsets: DataFrame) -> DataFrame:
    """`data` with pitch and roll less the mount offsets (``ID, pitch_offset, roll_offset``; records without them stay)."""
    met = data.join(offsets, "ID", "left")
    return met.withColumn("pitch", F.col("pitch") - F.coalesce("pitch_offset", F.lit(0.0))).withColumn("roll", wrap180(F.col("roll") - F.coalesce("roll_offset", F.lit(0.0)))).drop("pitch_offset", "roll_offset")


def smooth_orientation(data: DataFrame, window_s: float | None) -> DataFrame:
    """`data` with roll and heading as circular and pitch as linear means over `window_s` seconds."""
    if not window_s:
        return data
    had = "__us" in data.columns
    df, near = data if had else with_rate(data), seconds_frame(window_s)
    df = df.withColumn("roll", over_frame(F.col("roll"), near, -180.0)).withColumn("heading", over_frame(F.col("heading"), near)).withColumn("pitch", mean_over_seconds(F.col("pitch"), window_s))
    return df if had else df.drop("__us", "__rate")


def pivot(data: DataFrame, declination: float = 0.0, smoothing: Smoothing | dict | None = None, calibration: Calibration | dict | None = None, orientation: Orientation | dict | None = None, burst_quantile: float = 0.95, downsample_hz: float | None = 1.0, dry: DataFrame | None = None, drift: DepthDrift | dict | None = None, paddles: DataFrame | None = None, history: DataFrame | None = None):
    """The analysis-ready record: accel, static and dynamic parts, vedba, odba, burst, jerk, vertical velocity, pitch,
    roll, heading, turning angle; reduced to `downsample_hz` (slower records keep their rows) and rounded for storage.

    With `dry` (``ID, start, end``: when the tag was out of the water) depth loses its slow zero offset first, so the
    vertical velocity is that of the corrected depth. With `paddles` (``ID, slope``) a record that turns a paddle gets
    `paddle_freq` and `paddle_speed`. With `history` (see `tag`) the result is a pair of the record and the history with
    this step appended. IDs without accelerometer or depth values are skipped, not errors. Heading is NULL without
    magnetometer.
    """
    s, o = Smoothing.of(smoothing), Orientation.of(orientation)
    w = spec(order=("__us",))
    usable = data.groupBy("ID").agg(F.count("ax").alias("a"), F.count("depth").alias("d")).where("a > 0 and d > 0").select("ID")
    raw = data.join(usable, "ID", "left_semi")
    if dry is not None:
        from pelagia.operators.dives import zero_offset

        raw = zero_offset(raw, dry, drift).withColumn("depth", F.col("depth_corrected")).drop("depth_corrected", "drift_status")
    if o.algorithm == "madgwick":
        df = split_acceleration(attitude(raw, o.beta), s.static_s, s.dba_s)
    else:
        df = split_acceleration(raw, s.static_s, s.dba_s)
        pitch, roll = tilt(F.col("sx"), F.col("sy"), F.col("sz"))
        df = df.withColumn("pitch", pitch).withColumn("roll", roll)
        df = df.withColumn("heading", heading(F.col("pitch"), F.col("roll"), F.col("mx"), F.col("my"), F.col("mz"), declination, o.max_pitch))
    df = vertical_velocity(with_rate(df), s)
    # Two tables of one row per ID come from these few columns; without the cut each would work out the record anew.
    few = cut(df.select("ID", "__us", "__rate", "pitch", "roll", "vertical_velocity", "vedba"))
    df = with_burst(df, burst_limits(few, burst_quantile)).withColumn("accel", magnitude())
    df = smooth_orientation(without_offsets(with_jerk(df), mount_offsets(few, calibration)), s.orientation_s)
    df = df.withColumn("turning_angle", turning(F.col("heading"), w))
    linear = ["ax", "ay", "az", "depth", "temp", "accel", "surge", "sway", "heave", "vedba", "odba", "jerk", "vertical_velocity", "pitch", "turning_angle"]
    if paddles is not None:
        df = paddle_speed(df, paddles)
        linear += ["paddle_freq", "paddle_speed"]
    if downsample_hz is not None:
        df = time_bins(df, downsample_hz, linear, {"roll": -180.0, "heading": 0.0}, ["burst"], keep_slower=True)
    else:
        df = df.select("ID", "datetime", *linear, "roll", "heading", F.col("burst").cast("int").alias("burst"))
    out = stored(df)
    if history is None:
        return out
    from pelagia.operators.tag import append_history

    return out, append_history(history, usable, "pivot", {"static_s": s.static_s, "orientation_s": s.orientation_s, "depth_s": s.depth_s, "velocity_s": s.velocity_s, "algorithm": o.algorithm, "declination": declination, "downsample_hz": downsample_hz, "depth_drift": dry is not None})


def stored(df: DataFrame) -> DataFrame:
    """Rounded (half to even) to the decimals of each column's kind, NaN as NULL."""
    return df.select(*[F.bround(F.when(~F.isnan(c), F.col(c)), DECIMALS[c]).alias(c) if c in DECIMALS and t == "double" else F.col(c) for c, t in df.dtypes])


def anomalous_mounting(df: DataFrame, limit: float = 45.0) -> DataFrame:
    """IDs whose median pitch or roll is beyond `limit`."""
    return df.groupBy("ID").agg(F.percentile("pitch", 0.5).alias("pitch_median"), F.percentile("roll", 0.5).alias("roll_median")).withColumn("flag", (F.abs("pitch_median") > limit) | (F.abs("roll_median") > limit))


def paddle_frequency(data: DataFrame, window_s: float = 5.0, step_s: float = 1.0, band: tuple[float, float] = (0.5, 25.0)) -> DataFrame:
    """``ID, datetime, paddle_freq, paddle_quality``: dominant frequency of the paddle magnet in sliding windows.

    Windows are linearly detrended and tapered; quality is the peak over the mean of the rest of the band.
    """

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = table.column("datetime").cast(pa.int64()).to_numpy()
        x = numbers(table, "mz").astype(float)
        ids, rows = table.column("ID").take(pa.array(starts)).to_pylist(), []
        for k, (a, b) in enumerate(zip(starts.tolist(), np.r_[starts[1:], len(t)].tolist())):
            dt = np.median(np.diff(t[a:b])) / 1e6 if b - a > 2 else 0
            if dt <= 0 or 1 / dt < 2 * band[0]:
                continue
            n, hop = int(window_s / dt), max(int(step_s / dt), 1)
            if n < 8:
                continue
            taper, f = np.hanning(n), np.fft.rfftfreq(n, dt)
            inside = np.flatnonzero((f >= band[0]) & (f <= band[1]))
            if len(inside) < 3:
                continue
            line = np.arange(n) - (n - 1) / 2
            for p in range(a, b - n + 1, hop):
                y = x[p : p + n]
                if not np.all(np.isfinite(y)):
                    continue
                y = y - y.mean()
                y = (y - line * (line @ y) / (line @ line)) * taper
                power = np.abs(np.fft.rfft(y))[inside] ** 2
                i = int(np.argmax(power))
                rest = np.delete(power, i).mean()
                rows.append((ids[k], int(t[p + n // 2]), float(f[inside[i]]), float(power[i] / rest) if rest > 0 else 0.0))
        return pa.table({"ID": pa.array([r[0] for r in rows], pa.string()), "us": pa.array([r[1] for r in rows], pa.int64()), "paddle_freq": pa.array([r[2] for r in rows], pa.float64()), "paddle_quality": pa.array([r[3] for r in rows], pa.float64())})

    out = over_sorted_groups(data.select("ID", "datetime", "mz"), ["ID"], ["datetime"], kernel, "ID string, us bigint, paddle_freq double, paddle_quality double")
    return out.select("ID", F.timestamp_micros("us").alias("datetime"), "paddle_freq", "paddle_quality")


def paddle_speed(data: DataFrame, paddles: DataFrame, window_s: float = 5.0, step_s: float = 1.0, band: tuple[float, float] = (0.5, 25.0), least_hz: float = 50.0, smooth_s: float = 2.0) -> DataFrame:
    """`data` with `paddle_freq` and `paddle_speed` (m/s): the paddle's dominant frequency, linear between windows and
    averaged over `smooth_s` seconds, times the tag's slope (``ID, slope``).

    Records that have a speed already (not all NULL and not constant) keep it, and its frequency if there is one.
    Records without a slope, below `least_hz`, or whose magnet channel does not change have NULL.
    """
    had = [c for c in ("paddle_freq", "paddle_speed") if c in data.columns]
    df = data if "__us" in data.columns else with_rate(data)
    facts = df.groupBy("ID").agg(F.max("__rate").alias("hz"), F.min("mz").alias("lo"), F.max("mz").alias("hi"), *([(F.min("paddle_speed") < F.max("paddle_speed")).alias("kept")] if "paddle_speed" in had else [F.lit(False).alias("kept")]))
    asked = facts.join(paddles.groupBy("ID").agg(F.min("slope").alias("slope")), "ID").where("slope is not null and hi > lo and not coalesce(kept, false)").where(F.col("hz") >= least_hz)
    found = paddle_frequency(df.join(asked.select("ID"), "ID", "left_semi"), window_s, step_s, band).select("ID", F.unix_micros("datetime").alias("__us"), F.col("paddle_freq").alias("__f"))
    w, back = spec(order=("__us",)), reverse(("ID",), ("__us",))
    met = df.join(found, ["ID", "__us"], "left").join(asked.select("ID", F.col("slope").alias("__slope")), "ID", "left")
    met = met.withColumn("__f", interpolate(F.col("__f"), F.col("__us") / 1e6, w, None, back)).withColumn("__f", mean_over_seconds(F.col("__f"), smooth_s))
    own = {c: F.col(c) if c in had else F.lit(None).cast("double") for c in ("paddle_freq", "paddle_speed")}
    out = met.join(facts.select("ID", "kept"), "ID", "left").withColumn("paddle_speed", F.when(F.col("kept"), own["paddle_speed"]).otherwise(F.col("__f") * F.col("__slope"))).withColumn("paddle_freq", F.when(F.col("kept"), own["paddle_freq"]).otherwise(F.col("__f"))).drop("__f", "__slope", "kept")
    return out if "__us" in data.columns else out.drop("__us", "__rate")


def paddle_state(data: DataFrame, least_inflation: float = 1.5, least_hz: float = 3.0, rotations: float = 8.0, bounds: tuple[float, float] = (0.5, 3.0), turning_hz: float = 0.3, cell_s: int = 1800) -> DataFrame:
    """Per ID whether a paddle's magnet disturbs the magnetometer: ``ID, inflation, present, freq, prominence, window_s,
    separable``.

    `inflation` is the mean size of the field over that of the field averaged over a second. The line is the strongest peak
    over the median of the power spectrum from `least_hz` to nearly Nyquist; spectra are made per stretch of `cell_s`
    seconds and added up, so no record is held whole. `window_s` is what averages `rotations` turns (0: clean).
    """
    df = with_rate(data.where("mx is not null and my is not null and mz is not null"))
    near = seconds_frame(1.0)
    size, calm = magnitude("m"), F.sqrt(sum((F.avg(f"m{a}").over(near) ** 2 for a in "xyz"), F.lit(0.0)))
    ratio = df.select("ID", "__rate", size.alias("s"), calm.alias("c")).groupBy("ID").agg(F.try_divide(F.avg("s"), F.avg("c")).alias("inflation"), F.max("__rate").alias("hz"))
    spectra = power_spectra(df, ["mx", "my", "mz"], cell_s).where(F.col("freq") >= least_hz).where(F.col("freq") <= 0.98 * F.col("hz") / 2)
    middle = spectra.groupBy("ID", "channel").agg(F.percentile("power", 0.5).alias("mid"), F.max(F.struct("power", "freq")).alias("top"), F.count(F.lit(1)).alias("bins")).where("bins >= 5 and mid > 0")
    best = middle.groupBy("ID").agg(F.max(F.struct((F.col("top.power") / F.col("mid")).alias("prominence"), F.col("top.freq").alias("freq"))).alias("b"))
    present = F.coalesce(F.col("inflation") > least_inflation, F.lit(False))
    width = F.greatest(F.least(rotations / F.col("b.freq"), F.lit(bounds[1])), F.lit(bounds[0]))
    return ratio.join(best, "ID", "left").select("ID", "inflation", present.alias("present"), F.col("b.freq").alias("freq"), F.col("b.prominence").alias("prominence"), F.when(present & F.col("b.freq").isNotNull(), width).otherwise(0.0).alias("window_s"), F.when(present, F.col("b.freq") > rotations * turning_hz).alias("separable"))


def calm_field(data: DataFrame, state: DataFrame) -> DataFrame:
    """`data` with the magnetometer averaged over each record's `window_s` (see `paddle_state`) to the next half second; records
    without one, and rows whose window leaves the record, stay as they are."""
    df = with_rate(data).join(state.groupBy("ID").agg((F.max(F.round(F.col("window_s") * 2)) / 2).alias("__width")), "ID", "left")
    widths = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]
    out = {}
    for m in ("mx", "my", "mz"):
        calm = F.lit(None).cast("double")
        for s in widths:
            calm = F.when(F.col("__width") == s, mean_over_seconds(F.col(m), s)).otherwise(calm)
        out[m] = F.coalesce(calm, F.col(m))
    return df.withColumns(out).select(*data.columns)


def power_spectra(data: DataFrame, channels: list[str], cell_s: int = 1800, segment: int = 256) -> DataFrame:
    """``ID, channel, freq, power, hz``: power spectra by averaged Hann windows of `segment` rows, half overlapped.

    Windows are taken inside stretches of `cell_s` seconds and their sums added per record, so a long record is spread over
    many tasks. `hz` is the record's rate. Stretches with fewer rows than a window, and windows with missing values, count nothing.
    """
    df = data if "__rate" in data.columns else with_rate(data)
    cells = df.select("ID", F.expr(f"__us div {cell_s * 1_000_000}").alias("cell"), "__us", F.col("__rate").alias("hz"), *[F.col(c).cast("double").alias(c) for c in channels])

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        taper = np.hanning(segment + 1)[:-1]
        hz = numbers(table, "hz").astype(float)
        ids = table.column("ID").take(pa.array(starts)).to_pylist()
        out: list[tuple] = []
        for c in channels:
            x = numbers(table, c).astype(float)
            for k, (a, b) in enumerate(zip(starts.tolist(), np.r_[starts[1:], len(table)].tolist())):
                if b - a < segment or not np.isfinite(hz[a]):
                    continue
                parts = np.lib.stride_tricks.sliding_window_view(x[a:b], segment)[:: segment // 2]
                parts = parts[np.isfinite(parts).all(axis=1)]
                if len(parts):
                    p = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper)) ** 2).sum(axis=0)
                    out.append((ids[k], c, float(hz[a]), len(parts), p))
        return pa.table({"ID": pa.array([o[0] for o in out], pa.string()), "channel": pa.array([o[1] for o in out], pa.string()), "hz": pa.array([o[2] for o in out], pa.float64()), "n": pa.array([o[3] for o in out], pa.int64()), "p": pa.array([o[4].tolist() for o in out], pa.list_(pa.float64()))})

    sums = over_sorted_groups(cells, ["ID", "cell"], ["__us"], kernel, "ID string, channel string, hz double, n bigint, p array<double>")
    each = sums.select("ID", "channel", "hz", "n", F.posexplode("p").alias("k", "power"))
    return each.groupBy("ID", "channel", "k").agg(F.max("hz").alias("hz"), (F.sum("power") / F.sum("n")).alias("power")).select("ID", "channel", (F.col("k") * F.col("hz") / segment).alias("freq"), "power", "hz")
