"""Records on a regular time grid with nearest readings, gap-limited interpolation, and a report on what was done."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.signal import spline
from pelagia.grouped import numbers, over_sorted_groups
from pelagia.operators.joins import as_of
from pelagia.operators.tag import seconds
from pelagia.operators.windows import gap_length, interpolate, locf, spec
from pelagia.runtime import unfold


def grid(data: DataFrame) -> DataFrame:
    """``ID, datetime, step_us``: from the first to the last row in steps of the record's median step."""
    w = spec()
    steps = data.select("ID", F.unix_micros("datetime").alias("t"), (F.unix_micros("datetime") - F.lag(F.unix_micros("datetime")).over(w)).alias("dt"))
    span = steps.groupBy("ID").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.round(F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5)).cast("bigint").alias("step_us")).where("step_us > 0")
    steps = unfold(span.select("ID", "step_us", "a", F.expr("(z - a) div step_us").alias("n")), "0", "n", "k")
    return steps.select("ID", "step_us", F.timestamp_micros(F.col("a") + F.col("k") * F.col("step_us")).alias("datetime"))


def regularize(data: DataFrame, channels: list[str], max_gap: int = 5, method: str = "linear", threshold: float = 0.5, spline_cell: int = 4096) -> DataFrame:
    """Grid rows with the nearest reading of each channel, and `state` (``observed``, ``interpolated``, ``gap``).

    A reading further than `threshold` steps from a grid time does not count. NULL runs of at most `max_gap`
    grid rows inside the record are filled linearly, with the last value (``locf``), or by a natural cubic spline through
    the values of the grid (``spline``; per stretch of `spline_cell` rows with as much on both sides, which is far beyond
    what a spline feels). Another method is an error.
    """
    if method not in ("linear", "locf", "spline"):
        raise ValueError(f"unknown method: {method}")
    g = grid(data)
    met = as_of(g, data.select("ID", "datetime", F.col("datetime").alias("__at"), *[F.col(c).alias(c) for c in channels]), ["__at", *channels], "nearest")
    near = F.abs(F.unix_micros("__at") - F.unix_micros("datetime")) <= threshold * F.col("step_us")
    seen = met.select("ID", "datetime", "step_us", near.alias("__near"), *[F.when(near, F.col(c)).alias(c) for c in channels])
    w, t = spec(), seconds()

    def fill(c: str):
        if method == "spline":
            return F.coalesce(F.col(c), F.when((gap_length(F.col(c), w) <= max_gap) & F.col(f"__s_{c}").isNotNull(), F.col(f"__s_{c}")))
        if method == "locf":
            return F.coalesce(F.col(c), F.when(gap_length(F.col(c), w) <= max_gap, locf(F.col(c), w)))
        return interpolate(F.col(c), t, w, max_gap)

    if method == "spline":
        seen = _with_splines(seen, channels, spline_cell)
    out = seen.select("ID", "datetime", "__near", *[fill(c).alias(c) for c in channels])
    any_value = F.expr(" or ".join(f"{c} is not null" for c in channels))
    return out.withColumn("state", F.when(F.col("__near"), "observed").when(any_value, "interpolated").otherwise("gap")).drop("__near")


def _with_splines(seen: DataFrame, channels: list[str], cell: int) -> DataFrame:
    """`seen` with ``__s_<channel>``: the spline through each channel's values at every grid row between them."""
    names = [f"__s_{c}" for c in channels]
    numbered = seen.withColumn("__i", F.expr("unix_micros(datetime) div step_us"))
    home = F.expr(f"__i div {cell}")
    wide = numbered.select("ID", F.unix_micros("datetime").alias("us"), *channels, "__i", F.explode(F.array(home, home - 1, home + 1)).alias("cell")).withColumn("core", F.col("cell") == home)

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, core = numbers(table, "us") / 1e6, table.column("core").to_numpy(zero_copy_only=False).astype(bool)
        out = {}
        for c, name in zip(channels, names):
            x = numbers(table, c).astype(float)
            made = np.full(len(x), np.nan)
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(x)].tolist()):
                made[a:b] = spline(x[a:b], t[a:b] - t[a])
            out[name] = pa.array(made[core], from_pandas=True)
        keep = pa.array(core)
        return pa.table({"ID": table.column("ID").filter(keep), "us": table.column("us").filter(keep)} | out)

    made = over_sorted_groups(wide, ["ID", "cell"], ["us"], kernel, "ID string, us bigint, " + ", ".join(f"{n} double" for n in names))
    return seen.join(made.withColumn("datetime", F.timestamp_micros("us")).drop("us"), ["ID", "datetime"], "left")


def report(data: DataFrame, regular: DataFrame, review=(1.0, 5.0, 10.0), critical=(5.0, 20.0, 100.0)) -> DataFrame:
    """Per ID: rows added (%), share observed, interpolated and in gaps (%), number and length of gaps, jitter, a
    status (``ok``, ``review``, ``critical``) and a severity to sort by, worst first."""
    w = spec()
    before = data.groupBy("ID").agg(F.count(F.lit(1)).alias("n_before"))
    steps = data.select("ID", (seconds() - F.lag(seconds()).over(w)).alias("dt"))
    mid = steps.groupBy("ID").agg(F.percentile("dt", 0.5).alias("__m"))
    jitter = steps.join(mid, "ID").groupBy("ID").agg((1482.6 * F.percentile(F.abs(F.col("dt") - F.col("__m")), 0.5)).alias("jitter_ms"))
    marked = regular.withColumn("__g", (F.col("state") == "gap").cast("int"))
    marked = marked.withColumn("__run", F.sum(F.when((F.col("__g") == 1) & (F.coalesce(F.lag("__g").over(w), F.lit(0)) == 0), 1).otherwise(0)).over(w))
    gaps = marked.where("__g = 1").groupBy("ID", "__run").agg(F.count(F.lit(1)).alias("len")).groupBy("ID").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("len").alias("largest_gap"), F.percentile("len", 0.5).alias("median_gap"))
    share = regular.groupBy("ID").agg(F.count(F.lit(1)).alias("n_after"), *[(100 * F.avg((F.col("state") == s).cast("double"))).alias(f"{s}_pct") for s in ("observed", "interpolated", "gap")])
    out = before.join(share, "ID").join(gaps, "ID", "left").join(jitter, "ID", "left").withColumn("added_pct", 100 * (F.col("n_after") / F.col("n_before") - 1))
    values = (F.col("gap_pct"), F.col("interpolated_pct"), F.col("added_pct"))

    def beyond(limits):
        return (values[0] > limits[0]) | (values[1] > limits[1]) | (values[2] > limits[2])

    out = out.withColumn("status", F.when(beyond(critical), "critical").when(beyond(review), "review").otherwise("ok"))
    tier = F.when(F.col("status") == "critical", 2).when(F.col("status") == "review", 1).otherwise(0)
    return out.fillna(0, ["n_gaps", "largest_gap", "median_gap"]).withColumn("severity", tier * 1e6 + F.col("gap_pct") * 1000 + F.col("interpolated_pct") * 10 + F.col("added_pct") / 1e4)


def coverage(regular: DataFrame, bins: int = 1500) -> DataFrame:
    """The worst state per bin of each record's rows: ``ID, bin, worst``."""
    w = Window.partitionBy("ID").orderBy("datetime")
    numbered = regular.withColumn("bin", F.ntile(bins).over(w))
    level = F.when(F.col("state") == "gap", 2).when(F.col("state") == "interpolated", 1).otherwise(0)
    return numbered.groupBy("ID", "bin").agg(F.max(level).alias("l")).select("ID", "bin", F.element_at(F.array(F.lit("observed"), F.lit("interpolated"), F.lit("gap")), F.col("l") + 1).alias("worst"))
