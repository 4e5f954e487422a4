"""Magnetometer calibration: hard and soft iron from sums, so any number of points fits in one aggregation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.control import MagCalibration

_TERMS = ["x*x", "y*y", "z*z", "2*x*y", "2*x*z", "2*y*z", "2*x", "2*y", "2*z"]


def hard_iron(data: DataFrame, least: int = 100) -> DataFrame:
    """Per ID the middle of the 2 % and 98 % quantiles of each axis, half ranges, median radius, and whether the axes
    cover alike: NULL offsets under `least` points."""
    ok = data.where("mx is not null and my is not null and mz is not null")
    q = ok.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.array(F.lit(0.02), F.lit(0.98))).alias(f"q{c}") for c in ("mx", "my", "mz")])
    mid = {c: (F.get(f"q{c}", F.lit(0)) + F.get(f"q{c}", F.lit(1))) / 2 for c in ("mx", "my", "mz")}
    half = {c: (F.get(f"q{c}", F.lit(1)) - F.get(f"q{c}", F.lit(0))) / 2 for c in ("mx", "my", "mz")}
    one = q.select("ID", "n", *[mid[c].alias(f"c{c[1]}") for c in mid], *[half[c].alias(f"h{c[1]}") for c in half])
    r = ok.join(one, "ID").groupBy("ID").agg(F.percentile(F.sqrt((F.col("mx") - F.col("cx")) ** 2 + (F.col("my") - F.col("cy")) ** 2 + (F.col("mz") - F.col("cz")) ** 2), 0.5).alias("radius"))
    out = one.join(r, "ID")
    enough = F.col("n") >= least
    return out.select("ID", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("cx", "cy", "cz", "hx", "hy", "hz", "radius")], (enough & (F.least("hx", "hy", "hz") > 0.3 * F.greatest("hx", "hy", "hz"))).alias("covered"))


def coverage(data: DataFrame, centre: DataFrame) -> DataFrame:
    """Share of 12 by 6 cells of the sphere that hold a point: ``ID, cells, coverage``."""
    d = data.where("mx is not null and my is not null and mz is not null").join(centre.select("ID", "cx", "cy", "cz"), "ID")
    x, y, z = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy"), F.col("mz") - F.col("cz")
    r = F.sqrt(x * x + y * y + z * z)
    lon = F.floor((F.atan2(y, x) + np.pi) / (2 * np.pi) * 12)
    lat = F.floor((F.try_divide(z, F.nullif(r, F.lit(0.0))) + 1) / 2 * 6)
    cells = F.count_distinct(F.least(lon, F.lit(11)) * 6 + F.least(lat, F.lit(5)))
    return d.groupBy("ID").agg(cells.alias("cells"), (cells / 72).alias("coverage"))


def solve(sums: np.ndarray, right: np.ndarray, max_condition: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Centre, soft-iron matrix and radius of the ellipsoid ``v.A.v + 2 b.v = 1`` from its normal equations."""
    try:
        p = np.linalg.solve(sums, right)
    except np.linalg.LinAlgError:
        return None
    a = np.array([[p[0], p[3], p[4]], [p[3], p[1], p[5]], [p[4], p[5], p[2]]])
    b = p[6:9]
    try:
        centre = -np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    k = 1 + centre @ a @ centre
    values, vectors = np.linalg.eigh(a / k)
    if np.any(values <= 0) or values.max() / values.min() > max_condition**2:
        return None
    radius = float(np.prod(1 / np.sqrt(values)) ** (1 / 3))
    return centre, vectors @ np.diag(np.sqrt(values)) @ vectors.T * radius, radius


def ellipsoids(data: DataFrame, keys: list[str] | None = None, control: MagCalibration | dict | None = None) -> DataFrame:
    """Per key (by default ID) ``cx, cy, cz, s11..s33, radius, n, status``: the least-squares ellipsoid.

    The nine-parameter normal equations are sums over rows, made by one combining aggregation (values are scaled by
    100 to keep the sums well conditioned); only 9 by 9 systems reach the kernel. Status is ``fitted``, ``few_points``
    or ``failed`` (no ellipsoid, or too elongated); other columns are then NULL.
    """
    c = MagCalibration.of(control)
    keys = keys or ["ID"]
    v = data.where("mx is not null and my is not null and mz is not null").select(*keys, *[(F.col(m) / 100.0).alias(a) for m, a in (("mx", "x"), ("my", "y"), ("mz", "z"))])
    terms = v.select(*keys, *[F.expr(t).alias(f"t{k}") for k, t in enumerate(_TERMS)])
    sums = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"t{k}").alias(f"r{k}") for k in range(9)], *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"m{i}{j}") for i in range(9) for j in range(i, 9)])
    names = ["cx", "cy", "cz", *[f"s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], "radius"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found, status = None, "few_points"
                if row["n"] >= c.min_points:
                    m = np.array([[row[f"m{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)])
                    found = solve(m, np.array([row[f"r{k}"] for k in range(9)]), c.max_condition)
                    status = "fitted" if found else "failed"
                values = [*(found[0] * 100), *found[1].ravel(), found[2] * 100] if found else [None] * 13
                out.append({k: row[k] for k in keys} | dict(zip(names, [None if x is None else float(x) for x in values])) | {"n": row["n"], "status": status})
            yield pa.RecordBatch.from_pylist(out, pa.schema([*[(k, pa.string()) for k in keys], *[(n, pa.float64()) for n in names], ("n", pa.int64()), ("status", pa.string())]))

    return sums.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", " + ", ".join(f"{n} double" for n in names) + ", n bigint, status string")


def spread_of_radius(data: DataFrame) -> DataFrame:
    """Per ID the spread of the calibrated vectors' size: sd over median. It caps the confidence."""
    r = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    out = data.groupBy("ID").agg((F.stddev_samp(r) / F.nullif(F.percentile(r, 0.5), F.lit(0.0))).alias("radius_cv"))
    return out.withColumn("confidence", F.when(F.col("radius_cv") < 0.05, "high").when(F.col("radius_cv") < 0.15, "medium").otherwise("low"))


def agree(fits: DataFrame, external: DataFrame, reject: float = 0.35, warn: float = 0.10) -> DataFrame:
    """How far fitted centres are from an external calibration's, against the radius: ``ok``, ``warn``, ``reject``."""
    e = external.select("ID", *[F.col(c).alias(f"e{c}") for c in ("cx", "cy", "cz")])
    d = F.sqrt(sum(((F.col(c) - F.col(f"e{c}")) ** 2 for c in ("cx", "cy", "cz")), F.lit(0.0))) / F.col("radius")
    return fits.join(e, "ID").select("ID", d.alias("distance"), F.when(d > reject, "reject").when(d > warn, "warn").otherwise("ok").alias("verdict"))
