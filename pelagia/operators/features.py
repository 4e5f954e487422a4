"""Windowed features of several variables in one select over one sort; circular and enhanced metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.angles import mean_of
from pelagia.operators.tag import seconds
from pelagia.operators.windows import centred, full, rolling, spec, unwrapped

LINEAR = ["mean", "median", "sd", "min", "max", "sum", "range", "iqr", "mad", "rate", "energy", "skewness", "kurtosis", "entropy"]
CIRCULAR = ["mean", "median", "sd", "range", "iqr", "mrl", "rate"]
ENHANCED = ["net_change", "cumulative_change", "variance", "uturn", "smoothness", "jerk", "predictability", "zero_crossings", "autocorrelation", "turning_variability", "circling"]


def _wrap(x: Column) -> Column:
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def linear_metric(x: Column, metric: str, w, k: int, hz: float) -> Column:
    f = centred(w, k)
    if metric == "mad":
        values = F.collect_list(x).over(f)
        middle = F.percentile(x, 0.5).over(f)
        away = F.array_sort(F.transform(values, lambda v: F.abs(v - middle)))
        n = F.size(away)
        half = (F.get(away, F.floor((n - 1) / 2).cast("int")) + F.get(away, F.floor(n / 2).cast("int"))) / 2
        return full(1.4826 * half, w, k)
    if metric == "rate":
        raise ValueError("rates are made from differences by `features`")
    if metric == "entropy":
        return full(_entropy(F.collect_list(x).over(f)), w, k)
    return rolling(x, w, k, metric)


def _entropy(values: Column) -> Column:
    """Entropy (nats) of a histogram with Sturges' number of bins; NULL with fewer than two different values."""
    lo, hi, n = F.array_min(values), F.array_max(values), F.size(values)
    k = F.ceil(F.log2(n.cast("double")) + 1)
    width = (hi - lo) / k
    bins = F.transform(values, lambda v: F.least(F.floor(F.try_divide(v - lo, F.nullif(width, F.lit(0.0)))), k - 1))
    shares = F.transform(F.array_distinct(bins), lambda b: F.size(F.filter(bins, lambda c: c == b)) / n)
    return F.when(hi > lo, -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.ln(p)))


def _middle(values: Column) -> Column:
    """The median of an array."""
    z = F.array_sort(values)
    n = F.size(z)
    return (F.get(z, F.floor((n - 1) / 2).cast("int")) + F.get(z, F.floor(n / 2).cast("int"))) / 2


def _turned(values: Column) -> Column:
    """Angles in [0, 360), in order."""
    return F.array_sort(F.transform(values, lambda v: F.pmod(v, F.lit(360.0))))


def _circular_median(values: Column) -> Column:
    """The angle with the least sum of arcs to all others (the smallest of equals), in [-180, 180)."""

    def total(v):
        return F.aggregate(values, F.lit(0.0), lambda a, u: a + F.abs(F.pmod(u - v + 180.0, F.lit(360.0)) - 180.0))

    best = F.array_min(F.transform(values, lambda v: F.struct(F.round(total(v), 9).alias("d"), v.alias("v"))))
    return F.pmod(best["v"] + 180.0, F.lit(360.0)) - 180.0


def _circular_range(values: Column) -> Column:
    """The smallest arc that holds all angles."""
    n = F.size(values)
    gaps = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(i == n - 1, F.get(values, F.lit(0)) + 360.0 - F.get(values, n - 1)).otherwise(F.get(values, i + 1) - F.get(values, i)))
    return F.when(n > 0, 360.0 - F.array_max(gaps))


def circular_metric(x: Column, metric: str, w, k: int, hz: float) -> Column:
    f = centred(w, k)
    s, c = F.avg(F.sin(F.radians(x))).over(f), F.avg(F.cos(F.radians(x))).over(f)
    r = F.sqrt(s * s + c * c)
    values = _turned(F.collect_list(x).over(f))
    if metric == "mean":
        return full(mean_of(s, c, -180.0), w, k)
    if metric == "mrl":
        return full(r, w, k)
    if metric == "sd":
        return full(F.degrees(F.sqrt(-2 * F.ln(F.least(r, F.lit(1.0))))), w, k)
    if metric == "median":
        return full(_circular_median(values), w, k)
    if metric == "range":
        return full(_circular_range(values), w, k)
    if metric == "iqr":
        return full(F.abs(_wrap(F.percentile(x, 0.75).over(f) - F.percentile(x, 0.25).over(f))), w, k)
    raise ValueError(metric)


def features(data: DataFrame, grid: list[tuple[str, str, float]], hz: float = 1.0, circular: tuple[str, ...] = ("heading", "roll"), aggregate: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``ID, datetime`` and a column ``<variable>_<metric>_<seconds>`` per row of `grid`; rows with a NULL feature fall.

    Sliding windows are centred and whole; with `aggregate` windows follow each other from the record's first row
    (the last may be short) and there is one row per window. All columns share one sort. A circular variable
    with a metric that is only linear is an error.
    """
    for v, m, _ in grid:
        if m not in (CIRCULAR if v in circular else LINEAR):
            raise ValueError(f"{m} is no metric of {v}")
    w = spec()
    df = data
    for v in {v for v, m, _ in grid if m == "rate"}:
        step = F.col(v) - F.lag(v).over(w)
        df = df.withColumn(f"__d_{v}", F.abs(_wrap(step) if v in circular else step))
    names = {(v, m, s): f"{v}_{m}_{s:g}s" for v, m, s in grid}
    if aggregate:
        return _tumbling(df, grid, names, hz, circular)
    out = []
    for v, m, s in grid:
        k = max(round(s * hz), 1)
        if m == "rate":
            inner = w.rowsBetween(-((k - 1) // 2) + 1, k // 2)
            value = full(F.avg(f"__d_{v}").over(inner) * hz, w, k)
        else:
            value = circular_metric(F.col(v), m, w, k, hz) if v in circular else linear_metric(F.col(v), m, w, k, hz)
        out.append(value.alias(names[v, m, s]))
    return df.select("ID", "datetime", *keep, *out).dropna(subset=list(names.values()))


def _tumbling(df: DataFrame, grid, names, hz: float, circular) -> DataFrame:
    sizes = {max(round(s * hz), 1) for _, _, s in grid}
    if len(sizes) > 1:
        raise ValueError("aggregation needs one window size")
    w = spec()
    numbered = df.withColumn("__n", F.floor((F.row_number().over(w) - 1) / sizes.pop()))
    aggs = []
    for v, m, s in grid:
        x = F.col(v)
        si, co = F.avg(F.sin(F.radians(x))), F.avg(F.cos(F.radians(x)))
        r = F.sqrt(si * si + co * co)
        ways = {"mean": lambda: F.avg(x), "median": lambda: F.percentile(x, 0.5), "sd": lambda: F.stddev_samp(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "sum": lambda: F.sum(x), "range": lambda: F.max(x) - F.min(x), "iqr": lambda: F.percentile(x, 0.75) - F.percentile(x, 0.25), "energy": lambda: F.sum(x * x), "skewness": lambda: F.skewness(x), "kurtosis": lambda: F.kurtosis(x) + 3, "rate": lambda: F.avg(f"__d_{v}") * hz, "mad": lambda: 1.4826 * _middle(F.transform(F.collect_list(x), lambda u: F.abs(u - F.percentile(x, 0.5)))), "entropy": lambda: _entropy(F.collect_list(x))}
        if v in circular:
            ways = {"mean": lambda: mean_of(si, co, -180.0), "mrl": lambda: r, "sd": lambda: F.degrees(F.sqrt(-2 * F.ln(F.least(r, F.lit(1.0))))), "rate": lambda: F.avg(f"__d_{v}") * hz, "median": lambda: _circular_median(_turned(F.collect_list(x))), "range": lambda: _circular_range(_turned(F.collect_list(x))), "iqr": lambda: F.abs(_wrap(F.percentile(x, 0.75) - F.percentile(x, 0.25)))}
        aggs.append(ways[m]().alias(names[v, m, s]))
    return numbered.groupBy("ID", "__n").agg(F.min("datetime").alias("datetime"), *aggs).drop("__n")


def enhanced(data: DataFrame, k: int = 5, heading: str = "heading", variable: str = "depth") -> DataFrame:
    """`ID, datetime` and the enhanced metrics over windows of `k` rows: how heading and a variable change."""
    w = spec()
    f = centred(w, k)
    h, x = F.col(heading), F.col(variable)
    df = data.withColumn("__dh", _wrap(h - F.lag(h).over(w))).withColumn("__dx", x - F.lag(x).over(w)).withColumn("__m", F.avg(x).over(f)).withColumn("__s", F.stddev_samp(x).over(f))
    df = df.withColumn("__ddx", F.col("__dx") - F.lag("__dx").over(w))
    s, c = F.avg(F.sin(F.radians(h))).over(f), F.avg(F.cos(F.radians(h))).over(f)
    first, last = F.first(h, True).over(f), F.last(h, True).over(f)
    cum = F.sum(F.abs("__dh")).over(f)
    sign = F.collect_list(x).over(f)
    crossings = F.aggregate(F.transform(sign, lambda v: F.signum(F.round(v - F.col("__m"), 9))), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("p")), lambda a, v: F.struct((a["n"] + F.when((v != 0) & (a["p"] != 0) & (v != a["p"]), 1).otherwise(0)).alias("n"), F.when(v != 0, v).otherwise(a["p"]).alias("p")), lambda a: a["n"])
    values = F.collect_list(x).over(f)
    size = F.size(values)
    away = F.transform(values, lambda v: v - F.col("__m"))
    products = F.zip_with(F.slice(away, 1, F.greatest(size - 1, F.lit(0))), F.slice(away, 2, F.greatest(size - 1, F.lit(0))), lambda p, q: p * q)
    squares = F.aggregate(away, F.lit(0.0), lambda acc, v: acc + v * v)
    lag_one = F.when(squares > 1e-12, F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) / squares)
    turn_mean, turn_sd = F.avg(F.abs("__dh")).over(f), F.stddev_samp(F.abs("__dh")).over(f)
    return df.select(
        "ID", "datetime",
        full(F.abs(_wrap(F.lead(h, k // 2).over(w) - F.lag(h, k // 2).over(w))), w, k).alias("net_change"), full(cum, w, k).alias("cumulative_change"),
        F.when(F.count(h).over(f) * 2 >= k, 1 - F.sqrt(s * s + c * c)).alias("variance"), F.coalesce((F.abs(_wrap(last - first)) > 120).cast("int"), F.lit(0)).alias("uturn"),
        full(F.sqrt(F.avg(F.col("__ddx") ** 2).over(f)), w, k).alias("smoothness"), full(F.sqrt(F.avg(F.col("__dx") ** 2).over(f)), w, k).alias("jerk"),
        full(F.try_divide(F.stddev_samp("__m").over(f), F.abs(F.avg("__m").over(f)) + 0.001), w, k).alias("predictability"),
        full(crossings / k, w, k).alias("zero_crossings"), F.when(turn_mean == 0, 0.0).otherwise(F.try_divide(turn_sd, turn_mean)).alias("turning_variability"),
        full(cum / (F.abs(_wrap(last - first)) + 1), w, k).alias("circling"), full(lag_one, w, k).alias("autocorrelation"),
    )


def rhythms(data: DataFrame, k: int = 60, heading: str = "heading", variable: str = "depth") -> DataFrame:
    """``ID, datetime`` and metrics of regularity over centred windows of `k` rows: ``heading_autocorr_avg`` (mean of the
    autocorrelations at lags 1 to 5 of the heading without jumps; shorter windows at the ends count from ten values on),
    ``oscillation_regularity`` (spread over mean of the spacing of peaks after a mean of three, whole windows, three peaks at
    least), ``movement_consistency`` (the same of the sd over five rows), ``depth_change_rate`` (size of the change since the
    row before, no window) and ``depth_change_consistency`` (its spread over mean). Beyond the first and last whole window
    the last two spreads keep the nearest one.
    """
    w = spec()
    f = centred(w, k)
    everything = Window.partitionBy("ID")
    df = unwrapped(data, heading, "__h").withColumn("__d", F.abs(F.col(variable) - F.lag(variable).over(w))).withColumn("__sd", full(F.stddev_samp(variable).over(centred(w, 5)), w, 5))
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(everything))
    for c in ("__d", "__sd"):
        m, sd = F.avg(c).over(f), F.stddev_samp(c).over(f)
        spread = F.when(m == 0, 0.0).otherwise(sd / m) if c == "__d" else sd / (m + 0.001)
        df = df.withColumn(f"{c}_v", full(F.when(F.count(c).over(f) * 2 >= k, spread), w, k))
        low, high = (k - 1) // 2 + 1, F.col("__n") - k // 2
        first, last = (F.max(F.when(F.col("__i") == at, F.col(f"{c}_v"))).over(everything) for at in (low, high))
        df = df.withColumn(f"{c}_v", F.when(F.col("__i") < low, first).when(F.col("__i") > high, last).otherwise(F.col(f"{c}_v")))
    df = df.withColumn("__hs", F.collect_list("__h").over(f)).withColumn("__xs", F.collect_list(variable).over(f)).withColumn("__m", F.avg("__h").over(f))
    away = F.transform("__hs", lambda v: v - F.col("__m"))
    n = F.size("__hs")
    total = F.aggregate(away, F.lit(0.0), lambda a, v: a + v * v)

    def at_lag(lag: int):
        size = F.greatest(n - lag, F.lit(0))
        return F.aggregate(F.zip_with(F.slice(away, 1, size), F.slice(away, lag + 1, size), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)

    most = F.least(F.lit(5), F.floor(n / 4)).cast("int")
    acf = sum((F.when(most >= lag, at_lag(lag)).otherwise(0.0) for lag in range(1, 6)), F.lit(0.0)) / most / total
    smooth = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.round(F.aggregate(F.slice("__xs", F.greatest(F.least(i, F.lit(k - 1)), F.lit(2)) - 1, 3), F.lit(0.0), lambda a, v: a + v) / 3, 9))
    peaks = F.filter(F.sequence(F.lit(1), F.lit(k - 2)), lambda i: (F.get("__sm", i) > F.get("__sm", i - 1)) & (F.get("__sm", i) > F.get("__sm", i + 1)))
    df = df.withColumn("__sm", F.when(F.size("__xs") == k, smooth)).withColumn("__pk", F.when(F.col("__sm").isNotNull(), peaks))
    many = F.size("__pk")
    spacing = F.zip_with(F.slice("__pk", 1, F.greatest(many - 1, F.lit(0))), F.slice("__pk", 2, F.greatest(many - 1, F.lit(0))), lambda a, b: (b - a).cast("double"))
    df = df.withColumn("__iv", F.when(many >= 3, spacing))
    mean = F.aggregate("__iv", F.lit(0.0), lambda a, v: a + v) / F.size("__iv")
    df = df.withColumn("__im", mean)
    var = F.aggregate("__iv", F.lit(0.0), lambda a, v: a + (v - F.col("__im")) * (v - F.col("__im"))) / (F.size("__iv") - 1)
    return df.select("ID", "datetime", F.when((n >= 10) & (total > 1e-12), acf).alias("heading_autocorr_avg"), F.when(F.col("__iv").isNotNull(), F.sqrt(var) / F.col("__im")).alias("oscillation_regularity"), F.col("__sd_v").alias("movement_consistency"), F.col("__d").alias("depth_change_rate"), F.col("__d_v").alias("depth_change_consistency"))


def stability(data: DataFrame, k: int = 5) -> DataFrame:
    """Posture stability (one over one plus the rolling sd of pitch and roll) and an activity index (rolling mean of
    the changes of pitch, roll and heading)."""
    w = spec()
    f = centred(w, k)
    df = data.withColumn("__c", F.abs(F.col("pitch") - F.lag("pitch").over(w)) + F.abs(F.col("roll") - F.lag("roll").over(w)) + F.abs(_wrap(F.col("heading") - F.lag("heading").over(w))))
    return df.select("ID", "datetime", full(1 / (1 + F.stddev_samp("pitch").over(f) + F.stddev_samp("roll").over(f)), w, k).alias("posture_stability"), full(F.avg("__c").over(f), w, k).alias("activity_index"))


def surface_values(df: DataFrame, depth_zero: Column, names: dict[str, float]) -> DataFrame:
    """Fixed values of named features where depth is 0 (skewness 0, kurtosis 3, entropy 0)."""
    return df.select(*[F.when(depth_zero, F.lit(names[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def label_windows(rows: DataFrame, label: str, seconds_per_window: int, rule: str = "majority") -> DataFrame:
    """Response per window since the record's first row: 1 if the mean of the 0/1 label is over a half (or any is 1)."""
    first = rows.groupBy("ID").agg(F.min(seconds()).alias("__t0"))
    n = F.floor((seconds() - F.col("__t0")) / seconds_per_window)
    value = (F.avg(label) > 0.5).cast("int") if rule == "majority" else F.max(label)
    return rows.join(first, "ID").groupBy("ID", n.alias("window")).agg(value.alias("response"))


def top_segments(data: DataFrame, column: str, n: int = 5, window_s: float = 20.0, hz: float = 1.0) -> DataFrame:
    """The `n` strongest, mutually distant segments per ID by the size of a centred mean: ``ID, datetime, intensity, rank``.

    A reading can only be chosen if it is the strongest within half a window of its own; these local maxima (at most one per
    half window) are what the greedy choice, window by window, is made from.
    """
    import numpy as np
    import pyarrow as pa

    from pelagia.functions.signal import greedy_top
    from pelagia.grouped import numbers, over_sorted_groups

    w = spec()
    k = max(round(window_s * hz), 1)
    df = data.select("ID", "datetime", F.abs(F.avg(column).over(centred(w, k))).alias("intensity")).where("intensity is not null")

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, x = table.column("datetime").cast(pa.int64()).to_numpy(), numbers(table, "intensity").astype(float)
        at, place = [], []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(t)].tolist()):
            got = greedy_top(x[a:b], t[a:b] / 1e6, n, window_s)
            at += [a + g for g in got]
            place += list(range(1, len(got) + 1))
        take = pa.array(at, pa.int64())
        return pa.table({"ID": table.column("ID").take(take), "us": pa.array(t[at] if at else np.zeros(0, np.int64)), "intensity": pa.array(x[at] if at else np.zeros(0)), "rank": pa.array(place, pa.int64())})

    return over_sorted_groups(df, ["ID"], ["datetime"], kernel, "ID string, us bigint, intensity double, rank bigint").select("ID", F.timestamp_micros("us").alias("datetime"), "intensity", "rank")

