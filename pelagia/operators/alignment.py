"""Clock offset between a record and an ancillary depth series, or abstention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.control import Alignment
from pelagia.grouped import numbers, over_sorted_groups


def best_lag(t1: np.ndarray, x1: np.ndarray, t2: np.ndarray, x2: np.ndarray, c: Alignment) -> tuple[float, float, str]:
    """Lag (s) by which series 2 must be shifted, its correlation, and a status: ``aligned`` or why not."""
    lo, hi = max(t1.min(), t2.min() - c.max_lag_s), min(t1.max(), t2.max() + c.max_lag_s)
    if hi - lo < c.min_overlap_s:
        return np.nan, np.nan, "overlap"
    grid = np.arange(lo, hi, c.grid_s)
    a = np.interp(grid, t1, x1)
    if a.std() < c.min_sd or x2.std() < c.min_sd:
        return np.nan, np.nan, "flat"

    def fit(lag: float) -> float:
        ok = (grid >= t2.min() + lag) & (grid <= t2.max() + lag)
        if ok.sum() * c.grid_s < c.min_overlap_s:
            return -1.0
        b = np.interp(grid[ok], t2 + lag, x2)
        return float(np.corrcoef(a[ok], b)[0, 1]) if b.std() > 0 and a[ok].std() > 0 else -1.0

    coarse = np.arange(-c.max_lag_s, c.max_lag_s + 1, c.coarse_s)
    first = coarse[int(np.argmax([fit(float(k)) for k in coarse]))]
    fine = np.arange(first - c.coarse_s + 1, first + c.coarse_s)
    r = [fit(float(k)) for k in fine]
    k = int(np.argmax(r))
    if abs(fine[k]) >= c.max_lag_s:
        return float(fine[k]), r[k], "edge"
    return float(fine[k]), r[k], "aligned" if r[k] >= c.min_corr else "weak"


def clock_offsets(sensor: DataFrame, archive: DataFrame, control: Alignment | dict | None = None) -> DataFrame:
    """``ID, lag_s, corr, status`` for each ID that has depth in both tables; the archive is what must be shifted.

    Both series come in means per grid step, so a kernel holds a record's reduced depth only.
    """
    c = Alignment.of(control)

    def reduced(df: DataFrame, side: int) -> DataFrame:
        return df.where("depth is not null").groupBy("ID", F.floor(F.unix_micros("datetime") / (c.grid_s * 1_000_000)).cast("bigint").alias("b")).agg(F.avg("depth").alias("depth")).select("ID", F.lit(side).alias("side"), (F.col("b") * c.grid_s).cast("double").alias("t"), "depth")

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        side, t, x = (numbers(table, k) for k in ("side", "t", "depth"))
        ids, rows = table.column("ID").take(pa.array(starts)).to_pylist(), []
        for k, (a, b) in enumerate(zip(starts.tolist(), np.r_[starts[1:], len(t)].tolist())):
            one, two = side[a:b] == 0, side[a:b] == 1
            if one.sum() > 2 and two.sum() > 2:
                rows.append((ids[k], *best_lag(t[a:b][one], x[a:b][one], t[a:b][two], x[a:b][two], c)))
        return pa.table({n: pa.array([r[i] for r in rows], ty, from_pandas=True) for i, (n, ty) in enumerate((("ID", pa.string()), ("lag_s", pa.float64()), ("corr", pa.float64()), ("status", pa.string())))})

    return over_sorted_groups(reduced(sensor, 0).unionByName(reduced(archive, 1)), ["ID"], ["side", "t"], kernel, "ID string, lag_s double, corr double, status string")


def shift(ancillary: DataFrame, offsets: DataFrame) -> DataFrame:
    """Ancillary rows with their times moved by an aligned offset; others stay."""
    ok = offsets.where("status = 'aligned'").select("ID", "lag_s")
    moved = F.timestamp_micros((F.unix_micros("datetime") + F.coalesce(F.col("lag_s") * 1e6, F.lit(0.0))).cast("bigint"))
    return ancillary.join(ok, "ID", "left").select(*[moved.alias(c) if c == "datetime" else F.col(c) for c in ancillary.columns])
