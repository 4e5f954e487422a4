"""Tail-beat frequency and amplitude from a motion channel, by peaks of the autocorrelation and by wavelet ridge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.control import TailBeats
from pelagia.functions import signal
from pelagia.grouped import numbers, over_sorted_groups

COLUMNS = ["tbf_hz_peaks", "tbf_amplitude_peaks", "tbf_hz_wavelet", "tbf_amplitude_wavelet"]


def analyse(t: np.ndarray, x: np.ndarray, c: TailBeats, methods: tuple[str, ...]) -> dict[str, np.ndarray] | None:
    """Frequency and amplitude per sample; None if the record is too slow (Nyquist) or its time doesn't increase."""
    out = {k: np.full(len(x), np.nan) for k in COLUMNS}
    dt = np.diff(t)
    if len(t) < 16 or not np.all(dt > 0) or 1 / np.median(dt) <= 2 * c.max_hz:
        return None
    fs = float(1 / np.median(dt))
    for a, b in signal.finite_runs(x):
        if b - a < max(int(2 * fs / c.min_hz), 16):
            continue
        y = signal.filter_runs(x[a:b], fs, (c.min_hz, c.max_hz), "band", 2)
        if not np.all(np.isfinite(y)):
            continue
        size = signal.envelope(y)
        if "peaks" in methods:
            f, r = signal.acf_track(y, fs, c.min_hz, c.max_hz, c.window_s)
            out["tbf_hz_peaks"][a:b] = np.where(r >= c.min_periodicity, f, np.nan)
            out["tbf_amplitude_peaks"][a:b] = size
        if "wavelet" in methods:
            f, p = signal.morlet_ridge(y, fs, c.min_hz, c.max_hz, prominence=c.ridge_prominence)
            out["tbf_hz_wavelet"][a:b] = f
            out["tbf_amplitude_wavelet"][a:b] = p
    return out


def swimming(amplitude: np.ndarray, t: np.ndarray, high: float, least_s: float) -> np.ndarray:
    """Hysteresis of the envelope between `high` and 0.6 `high`; bouts under `least_s` don't count."""
    state, on = np.zeros(len(t), bool), False
    for i, v in enumerate(amplitude.tolist()):
        on = v > high if not on else v >= 0.6 * high
        state[i] = on
    for a, b in zip(*[np.flatnonzero(np.diff(np.r_[0, state.astype(int), 0]) == s) for s in (1, -1)]):
        if t[b - 1] - t[a] < least_s:
            state[a:b] = False
    return state


def tail_beats(data: DataFrame, motion: str = "sway", methods: tuple[str, ...] = ("peaks", "wavelet"), min_amplitude: float | None = None, control: TailBeats | dict | None = None) -> DataFrame:
    """``ID, datetime`` and ``tbf_hz_<m>, tbf_amplitude_<m>, tbf_swimming, tbf_agree``.

    Records too slow for the highest frequency, or with times that don't increase, keep their rows with NULLs, so
    results of all records unite. Swimming is judged against `min_amplitude` (by default the median envelope).
    """
    c = TailBeats.of(control)
    schema = "ID string, us bigint, " + ", ".join(f"{k} double" for k in COLUMNS) + ", tbf_swimming boolean"

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        us, x = table.column("datetime").cast(pa.int64()).to_numpy(), numbers(table, motion).astype(float)
        out = {k: np.full(len(x), np.nan) for k in COLUMNS}
        swim = np.full(len(x), None, object)
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(x)].tolist()):
            found = analyse(us[a:b] / 1e6, x[a:b], c, methods)
            if found is None:
                continue
            for k, v in found.items():
                out[k][a:b] = v
            size = found["tbf_amplitude_peaks"] if "peaks" in methods else found["tbf_amplitude_wavelet"]
            ok = np.isfinite(size)
            if ok.any():
                high = min_amplitude if min_amplitude is not None else float(np.median(size[ok]))
                swim[a:b] = swimming(np.where(ok, size, 0.0), us[a:b] / 1e6, high, c.min_swim_s)
        return pa.table({"ID": table.column("ID"), "us": pa.array(us)} | {k: pa.array(v, from_pandas=True) for k, v in out.items()} | {"tbf_swimming": pa.array(swim.tolist(), pa.bool_())})

    rows = over_sorted_groups(data.select("ID", "datetime", F.col(motion).cast("double").alias(motion)), ["ID"], ["datetime"], kernel, schema)
    a, b = F.col("tbf_hz_peaks"), F.col("tbf_hz_wavelet")
    return rows.select("ID", F.timestamp_micros("us").alias("datetime"), *COLUMNS, "tbf_swimming", (F.abs(a - b) / F.greatest(a, b) < 0.1).alias("tbf_agree"))


def column_for(columns: list[str], quantity: str = "hz", method: str | None = None) -> str | None:
    """The column of a quantity (``hz``, ``amplitude``, ``swimming``), of the named method or the first there is."""
    if quantity == "swimming":
        return "tbf_swimming" if "tbf_swimming" in columns else None
    order = [method] if method else ["peaks", "wavelet"]
    return next((f"tbf_{quantity}_{m}" for m in order if f"tbf_{quantity}_{m}" in columns), None)


def best_axis(data: DataFrame, axes: tuple[str, ...] = ("surge", "sway", "heave"), low: float = 0.1, high: float = 3.0) -> DataFrame:
    """Per ID the axis to count tail beats on: among axes whose dominant frequency agrees with the median one within
    15 %, the one with most power: ``ID, axis, hz, power``."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        us = table.column("datetime").cast(pa.int64()).to_numpy()
        ids, rows = table.column("ID").take(pa.array(starts)).to_pylist(), []
        xs = {a: numbers(table, a).astype(float) for a in axes}
        for k, (a, b) in enumerate(zip(starts.tolist(), np.r_[starts[1:], len(us)].tolist())):
            dt = np.median(np.diff(us[a:b])) / 1e6 if b - a > 2 else 0
            if dt <= 0:
                continue
            seen = []
            for axis in axes:
                f, p = signal.welch(xs[axis][a:b], 1 / dt)
                if len(f) and f[-1] > low:
                    seen.append((axis, signal.dominant(f, p, low, min(high, f[-1])), signal.band_power(f, p, low, high)))
            seen = [s for s in seen if np.isfinite(s[1])]
            if seen:
                middle = np.median([s[1] for s in seen])
                near = [s for s in seen if abs(s[1] - middle) <= 0.15 * middle] or seen
                rows.append((ids[k], *max(near, key=lambda s: s[2])))
        return pa.table({n: pa.array([r[i] for r in rows], ty) for i, (n, ty) in enumerate((("ID", pa.string()), ("axis", pa.string()), ("hz", pa.float64()), ("power", pa.float64())))})

    return over_sorted_groups(data.select("ID", "datetime", *axes), ["ID"], ["datetime"], kernel, "ID string, axis string, hz double, power double")
