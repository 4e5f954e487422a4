"""The deployed part of a record: attachment and release from depth, with temperature to refine it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.grouped import numbers, over_sorted_groups


def segment_cost(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]


def change_points(x: np.ndarray, most: int = 6, least: int = 30) -> list[int]:
    """Binary segmentation for changes of mean and variance (Gaussian likelihood, penalty 3 ln n)."""
    s, q = segment_cost(x)

    def cost(a, b):
        n = b - a
        var = np.maximum((q[b] - q[a]) / n - ((s[b] - s[a]) / n) ** 2, 1e-6)
        return n * np.log(var)

    cuts = [0, len(x)]
    penalty = 3 * np.log(max(len(x), 2))
    while len(cuts) - 2 < most:
        best = (penalty, -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2 * least:
                continue
            k = np.arange(a + least, b - least + 1)
            gain = cost(a, b) - cost(a, k) - cost(k, b)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), int(k[i]))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    return cuts[1:-1]


def bounds_of(t: np.ndarray, depth: np.ndarray, temp: np.ndarray | None, depth_limit: float, var_limit: float, most: int, pad: int, use_temp: bool) -> tuple[float, float] | None:
    """First and last time of the deployment in a series of means per second; None if it never leaves the surface."""
    ok = np.isfinite(depth)
    if ok.sum() < 10:
        return None
    d = np.interp(t, t[ok], depth[ok])
    x = np.r_[np.zeros(pad), d, np.zeros(pad)]
    cuts = [0, *change_points(x, most), len(x)]
    deep = [(a, b) for a, b in zip(cuts, cuts[1:]) if not (x[a:b].mean() < depth_limit and x[a:b].var() < var_limit)]
    if not deep or max(x[a:b].mean() for a, b in deep) < depth_limit:
        return None
    first, last = max(deep[0][0] - pad, 0), min(deep[-1][1] - pad, len(d)) - 1
    if use_temp and temp is not None and np.isfinite(temp).sum() > 20:
        out = np.r_[temp[:first], temp[last + 1 :]]
        out = out[np.isfinite(out)]
        if len(out) > 20:  # in water where temperature differs from that outside
            mid = np.median(out)
            tol = max(1.0, 4 * 1.4826 * np.median(np.abs(out - mid)))
            wet = np.abs(temp - mid) >= tol
            while first > 0 and wet[first - 1]:
                first -= 1
            while last < len(d) - 1 and wet[last + 1]:
                last += 1
    return float(t[first]), float(t[last])


def deployment_bounds(data: DataFrame, depth_limit: float = 3.5, var_limit: float = 6.0, most: int = 6, pad_s: int = 3600, use_temp: bool = True, least_h: float = 0.25) -> DataFrame:
    """``ID, attach_us, pop_us`` from means per second; IDs that are never deployed are left out.

    The means are made in an ordinary aggregation; the search over a record's change points needs its whole
    (reduced) series and runs in a kernel per ID.
    """
    means = data.groupBy("ID", F.floor(F.unix_micros("datetime") / 1_000_000).cast("bigint").alias("s")).agg(F.avg(F.greatest("depth", F.lit(0.0))).alias("depth"), F.avg("temp").alias("temp"))

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, d, c = numbers(table, "s").astype(float), numbers(table, "depth"), numbers(table, "temp")
        ends, rows = np.r_[starts[1:], len(t)], []
        ids = table.column("ID").take(pa.array(starts)).to_pylist()
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            step = float(np.median(np.diff(t[a:b]))) if b - a > 1 else 1.0
            found = bounds_of(t[a:b], d[a:b], c[a:b], depth_limit, var_limit, most, max(int(pad_s / max(step, 1.0)), 30), use_temp)
            if found and found[1] - found[0] >= least_h * 3600:
                rows.append((ids[k], int(found[0] * 1e6), int((found[1] + 1) * 1e6) - 1))
        return pa.table({"ID": pa.array([r[0] for r in rows], pa.string()), "attach_us": pa.array([r[1] for r in rows], pa.int64()), "pop_us": pa.array([r[2] for r in rows], pa.int64())})

    return over_sorted_groups(means, ["ID"], ["s"], kernel, "ID string, attach_us bigint, pop_us bigint")


def trim(data: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows between attachment and release, both included; IDs without bounds have no rows."""
    return data.join(bounds, "ID").where(F.unix_micros("datetime").between(F.col("attach_us"), F.col("pop_us"))).select(*data.columns)


def custom_bounds(data: DataFrame, given: DataFrame) -> DataFrame:
    """Bounds from given times (either may be NULL), cut to the record."""
    span = data.groupBy("ID").agg(F.min(F.unix_micros("datetime")).alias("a"), F.max(F.unix_micros("datetime")).alias("z"))
    return span.join(given, "ID", "left").select("ID", F.greatest("a", F.coalesce(F.unix_micros("attach"), F.col("a"))).alias("attach_us"), F.least("z", F.coalesce(F.unix_micros("pop"), F.col("z"))).alias("pop_us"))
