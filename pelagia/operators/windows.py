"""Windowed columns over time-ordered records: rolling statistics, fills, runs, state machines.

All functions return column expressions over ``partitionBy(*keys).orderBy(order)``; they share that one
specification so that a plan needs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spec(keys=("ID",), order=("datetime",)):
    return Window.partitionBy(*keys).orderBy(*order)


def reverse(keys=("ID",), order=("datetime",)):
    """The same specification read backwards. What looks ahead without bound is written as looking back over this
    one: a frame that ends at the partition's end would be worked out anew for every row."""
    return Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])


def centred(w, k: int):
    """The frame of a centred window of `k` rows: (k-1)//2 before, k//2 behind."""
    return w.rowsBetween(-((k - 1) // 2), k // 2)


def full(value: Column, w, k: int) -> Column:
    """`value`, but NULL where the centred window of `k` rows is not complete."""
    return F.when(F.count(F.lit(1)).over(centred(w, k)) == k, value)


def rolling(x: Column, w, k: int, metric: str) -> Column:
    """Rolling mean, sum, min, max, sd, median, range, iqr, energy, skewness or kurtosis; NULL at the edges."""
    f = centred(w, k)
    made = {
        "mean": lambda: F.avg(x).over(f), "sum": lambda: F.sum(x).over(f), "min": lambda: F.min(x).over(f), "max": lambda: F.max(x).over(f),
        "sd": lambda: F.stddev_samp(x).over(f), "median": lambda: F.percentile(x, 0.5).over(f), "range": lambda: F.max(x).over(f) - F.min(x).over(f),
        "iqr": lambda: F.percentile(x, 0.75).over(f) - F.percentile(x, 0.25).over(f), "energy": lambda: F.sum(x * x).over(f),
        "skewness": lambda: F.skewness(x).over(f), "kurtosis": lambda: F.kurtosis(x).over(f) + 3,
    }
    return full(made[metric](), w, k)


def edge_mean(x: Column, w, k: int) -> Column:
    """Centred mean of an odd number of rows, the first and last value repeated beyond the edges."""
    k += 1 - k % 2
    h = k // 2
    f, everything = w.rowsBetween(-h, h), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, i = F.count(F.lit(1)).over(everything), F.row_number().over(w)
    left, right = F.greatest(h - i + 1, F.lit(0)), F.greatest(h - (n - i), F.lit(0))
    first, last = F.first(x).over(everything), F.last(x).over(everything)
    total = F.coalesce(F.sum(x).over(f), F.lit(0.0)) + left * F.coalesce(first, F.lit(0.0)) + right * F.coalesce(last, F.lit(0.0))
    many = F.count(x).over(f) + F.when(first.isNotNull(), left).otherwise(0) + F.when(last.isNotNull(), right).otherwise(0)
    return F.when(many > 0, total / many)


def with_rate(df: DataFrame) -> DataFrame:
    """`df` with `__us` (microseconds) and `__rate` (rows a second: one over the record's median step)."""
    df = df.withColumn("__us", F.unix_micros("datetime"))
    df = df.withColumn("__dt", F.col("__us") - F.lag("__us").over(spec(order=("__us",))))
    return df.withColumn("__rate", 1e6 / F.percentile(F.when(F.col("__dt") > 0, F.col("__dt")), 0.5).over(Window.partitionBy("ID"))).drop("__dt")


def seconds_frame(s: float):
    """The frame of the `s` seconds around a row of `with_rate`; at a steady rate those of `centred`."""
    half = round(s * 500_000)
    return spec(order=("__us",)).rangeBetween(1 - half, half)


def mean_over_seconds(x: Column, s: float | None) -> Column:
    """Mean of `x` over `s` seconds in a frame `with_rate`; without `s` it is `x`.

    NULL where a value is missing in the frame, and at the record's ends as far as the frame reaches beyond them;
    where `s` seconds hold one row, it is that row's value.
    """
    if not s:
        return x
    w, f = spec(order=("__us",)), seconds_frame(s)
    k = F.greatest(F.coalesce(F.round(F.col("__rate") * s), F.lit(1.0)), F.lit(1.0))
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("ID"))
    inside = (i - 1 >= F.floor((k - 1) / 2)) & (n - i >= F.floor(k / 2))
    return F.when(inside & (F.count(x).over(f) == F.count(F.lit(1)).over(f)), F.avg(x).over(f))


def locf(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def nocb(x: Column, back=None) -> Column:
    back = reverse() if back is None else back
    return F.last(x, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def gap_length(x: Column, w, back=None) -> Column:
    """Rows of the run of NULLs that a row lies in; 0 on a value."""
    back = reverse() if back is None else back
    i, j, known = F.row_number().over(w), F.row_number().over(back), x.isNotNull()
    # Rows since the last value and, read backwards, rows until the next one.
    before = i - F.coalesce(locf(F.when(known, i), w), F.lit(0))
    behind = j - F.coalesce(nocb(F.when(known, j), back), F.lit(0))
    return F.when(known, 0).otherwise(before + behind - 1)


def interpolate(x: Column, t: Column, w, max_gap: int | None = None, back=None) -> Column:
    """Linear interpolation of inner NULL runs of at most `max_gap` rows; the outer ones stay NULL."""
    known = F.when(x.isNotNull(), F.struct(t.alias("t"), x.alias("x")))
    a, b = locf(known, w), nocb(known, back)
    line = F.when(a.isNotNull() & b.isNotNull(), a["x"] + (b["x"] - a["x"]) * (t - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0)))
    if max_gap is not None:
        line = F.when(gap_length(x, w, back) <= max_gap, line)
    return F.coalesce(x, line)


def lookup(x: Column, t: Column, w, back=None) -> Column:
    """Piecewise linear through the known values, constant beyond the first and last."""
    return F.coalesce(interpolate(x, t, w, None, back), locf(x, w), nocb(x, back))


def hysteresis(x: Column, high: Column, low: Column, w) -> Column:
    """1 after `x` rose above `high`, 0 after it fell below `low`, unchanged between; 0 at first."""
    return F.coalesce(locf(F.when(x > high, 1).when(x < low, 0), w), F.lit(0))


def run_id(*values: Column, w, split: Column | None = None) -> Column:
    """Number of the run of equal values (NULLs are equal) that a row lies in; `split` starts a new one."""
    first = F.row_number().over(w) == 1
    changed = first
    for v in values:
        changed = changed | ~v.eqNullSafe(F.lag(v).over(w))
    if split is not None:
        changed = changed | F.coalesce(split, F.lit(False))
    return changed.cast("int")


def with_runs(df: DataFrame, values: list[str], keys=("ID",), order=("datetime",), split: Column | None = None, name: str = "run") -> DataFrame:
    """`df` with the number of the run of equal `values` per key."""
    w = spec(keys, order)
    return df.withColumn("__new", run_id(*[F.col(v) for v in values], w=w, split=split)).withColumn(name, F.sum("__new").over(w)).drop("__new")


def drop_short_runs(df: DataFrame, flag: str, least: int, keys=("ID",), order=("datetime",)) -> DataFrame:
    """`flag` with runs under `least` rows taken over by the run before (or, at the start, behind)."""
    w = spec(keys, order)
    runs = with_runs(df, [flag], keys, order, name="__run")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__run"))
    kept = runs.withColumn("__kept", F.when(size >= least, F.col(flag)))
    return kept.withColumn(flag, F.coalesce(locf(F.col("__kept"), w), nocb(F.col("__kept"), reverse(keys, order)), F.col(flag))).drop("__run", "__kept")


def longest_run(df: DataFrame, flag: str, keys=("ID",), order=("datetime",)) -> DataFrame:
    """Per key the longest run of true rows (the first of equals): its first and last order value and length."""
    runs = with_runs(df, [flag], keys, order, name="__run").where(F.col(flag))
    each = runs.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("begin"), F.max(order[0]).alias("end"))
    return each.groupBy(*keys).agg(F.min_by(F.struct("begin", "end", "n"), F.struct(-F.col("n"), F.col("begin"))).alias("x")).select(*keys, "x.*")


def central_rate(x: Column, t: Column, w) -> Column:
    """Central difference rate, one-sided at the ends."""
    a, b = F.coalesce(F.lag(x).over(w), x), F.coalesce(F.lead(x).over(w), x)
    ta, tb = F.coalesce(F.lag(t).over(w), t), F.coalesce(F.lead(t).over(w), t)
    return F.try_divide(b - a, F.nullif(tb - ta, F.lit(0.0)))


def turning(h: Column, w) -> Column:
    """Half the wrapped heading change between the neighbours; one-sided (whole) at the ends."""
    a, b = F.lag(h).over(w), F.lead(h).over(w)
    both = (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0) / 2
    end = F.pmod(F.coalesce(b, h) - F.coalesce(a, h) + 180.0, F.lit(360.0)) - 180.0
    return F.when(a.isNotNull() & b.isNotNull(), both).when(F.row_number().over(w) == 1, end).when(b.isNull(), end).otherwise(end)


def unwrapped(df: DataFrame, heading: str, name: str = "unwrapped", keys=("ID",), order=("datetime",)) -> DataFrame:
    """`df` with the heading without jumps: the first value plus all wrapped changes."""
    w = spec(keys, order)
    h = F.col(heading)
    step = F.coalesce(F.pmod(h - F.lag(h).over(w) + 180.0, F.lit(360.0)) - 180.0, F.when(F.row_number().over(w) == 1, h))
    return df.withColumn("__step", step).withColumn(name, F.sum("__step").over(w)).drop("__step")


def first_per_bin(df: DataFrame, bin_column: Column, keys=("ID",), order=("datetime",)) -> DataFrame:
    """The first row of each bin."""
    binned = df.withColumn("__bin", bin_column)
    w = Window.partitionBy(*keys, "__bin").orderBy(*order)
    return binned.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__bin")


def stride_sample(df: DataFrame, most: int, keys=("ID",), order=("datetime",)) -> DataFrame:
    """Evenly strided rows, at most `most` per key and always the last."""
    w = spec(keys, order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, i = F.count(F.lit(1)).over(everything), F.row_number().over(w)
    step = F.greatest(F.ceil(n / F.lit(max(most - 1, 1))), F.lit(1))
    return df.withColumn("__keep", ((i - 1) % step == 0) | (i == n)).where("__keep").drop("__keep")


def sub_rate_channels(df: DataFrame, channels: list[str], keys=("ID",), order=("datetime",)) -> DataFrame:
    """Per key and channel the median spacing in rows of its values; over 1.5 it is recorded at a lower rate."""
    w = spec(keys, order)
    numbered = df.withColumn("__i", F.row_number().over(w))
    for c in channels:
        at = F.when(F.col(c).isNotNull(), F.col("__i"))
        numbered = numbered.withColumn(f"__d_{c}", at - F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = numbered.groupBy(*keys).agg(*[F.percentile(f"__d_{c}", 0.5).alias(c) for c in channels])
    return out.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("spacing")) for c in channels])).alias("x")).select(*keys, "x.*").withColumn("sub_rate", F.col("spacing") > 1.5)
