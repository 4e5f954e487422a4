"""Sun events and diel phase (public low-accuracy solar formulae), in NumPy over Arrow batches.

As column expressions the formulae, applied twice for each event, grow beyond what a plan can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sun(jd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Declination (degrees) and equation of time (minutes) at Julian days."""
    c = (jd - 2451545.0) / 36525.0
    lon = np.radians((280.46646 + c * (36000.76983 + c * 0.0003032)) % 360)
    m = np.radians(357.52911 + c * (35999.05029 - c * 0.0001537))
    ecc = 0.016708634 - c * (0.000042037 + c * 0.0000001267)
    centre = np.sin(m) * (1.914602 - c * (0.004817 + c * 0.000014)) + np.sin(2 * m) * (0.019993 - c * 0.000101) + np.sin(3 * m) * 0.000289
    omega = np.radians(125.04 - 1934.136 * c)
    apparent = lon + np.radians(centre - 0.00569 - 0.00478 * np.sin(omega))
    tilt = np.radians(23.0 + (26.0 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 + 0.00256 * np.cos(omega))
    y = np.tan(tilt / 2) ** 2
    time = 4 * np.degrees(y * np.sin(2 * lon) - 2 * ecc * np.sin(m) + 4 * ecc * y * np.sin(m) * np.cos(2 * lon) - 0.5 * y * y * np.sin(4 * lon) - 1.25 * ecc * ecc * np.sin(2 * m))
    return np.degrees(np.arcsin(np.sin(tilt) * np.sin(apparent))), time


def event(day, lon, lat, depression: float, rising: bool) -> np.ndarray:
    """Seconds since the epoch at which the sun stands `depression` degrees under the horizon on the days (since the
    epoch) at the places; NaN where it never does. The time is refined once."""
    day, lon, lat = (np.asarray(x, float) for x in (day, lon, lat))
    t = day * 86_400 + 43_200 - 240 * lon
    for _ in range(2):
        declination, eqt = sun(t / 86_400 + 2440587.5)
        d, p = np.radians(declination), np.radians(lat)
        with np.errstate(invalid="ignore"):
            cos_h = (np.cos(np.radians(90 + depression)) - np.sin(p) * np.sin(d)) / (np.cos(p) * np.cos(d))
            half = np.degrees(np.arccos(np.where(np.abs(cos_h) <= 1, cos_h, np.nan)))
        t = day * 86_400 + 60 * (720 - 4 * lon - eqt + (-4 if rising else 4) * half)
    return t


def phases_of(seconds: np.ndarray, lon: np.ndarray, lat: np.ndarray, phases: int, twilight: float) -> np.ndarray:
    """Names of the phases; None where an event that is needed does not occur."""
    day = np.floor((seconds + 240 * lon) / 86_400)  # the day of local noon
    rise, fall = event(day, lon, lat, 0.833, True), event(day, lon, lat, 0.833, False)
    light = (seconds >= rise) & (seconds < fall)
    if phases == 2:
        out = np.where(light, "day", "night").astype(object)
        out[~np.isfinite(rise + fall)] = None
        return out
    dawn, dusk, late = event(day, lon, lat, twilight, True), event(day, lon, lat, twilight, False), event(day - 1, lon, lat, twilight, False)
    dark = (seconds >= dusk) | ((seconds < dawn) & (seconds >= late))
    between = np.where(seconds < rise, "dawn", "dusk") if phases == 4 else np.full(len(seconds), "twilight")
    out = np.where(light, "day", np.where(dark, "night", between)).astype(object)
    out[~np.isfinite(rise + fall + dawn + dusk + late)] = None
    return out


def with_diel_phase(df: DataFrame, name: str = "phase", phases: int = 2, twilight: float = 18.0, time: str = "datetime", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """`df` with the phase of each row: ``day`` and ``night`` (2), ``twilight`` (3) or ``dawn`` and ``dusk`` (4); NULL without
    time or place, and where the sun's events do not occur. A time before dawn is compared with the dusk before."""

    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("__t").cast(pa.float64()).to_numpy(zero_copy_only=False) / 1e6
            x, y = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("__lon", "__lat"))
            out = phases_of(t, x, y, phases, twilight) if len(t) else np.zeros(0, object)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out.tolist(), pa.string())], [*columns, name])

    ready = df.select("*", F.unix_micros(time).alias("__t"), F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat"))
    return ready.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} string")
