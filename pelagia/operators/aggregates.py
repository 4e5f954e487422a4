"""Aggregations: time bins, time at a value, distributions, summaries, votes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.angles import circular_mean
from pelagia.operators.tag import seconds


def time_bins(data: DataFrame, hz: float, linear: list[str], circular: dict[str, float] | None = None, flags: list[str] | None = None, keep_slower: bool = False, times: DataFrame | None = None) -> DataFrame:
    """Means per bin of ``1/hz`` seconds, counted from each record's first row.

    With `keep_slower` a record whose rate (one over its median step, whole Hz from 1 Hz on) is not above `hz` keeps
    its own rows and times: there is nothing to reduce.

    `circular` maps angle columns to the lower end of their range; `flags` are true if any row's is. One
    aggregation makes all columns. The first time (and the rate) of a record is an aggregation too, joined back as one row per
    ID, so no record is gathered in one task; steps are taken inside days, which their median does not feel. `times` may
    name rows with the same ID and datetime that are cheaper to read than `data` (repeated ones do no harm).
    """
    us = F.unix_micros("datetime")
    times = (data if times is None else times.where("ID is not null and datetime is not null")).select("ID", us.alias("__us"))
    facts = [F.min("__us").alias("__t0")]
    if keep_slower:
        within = Window.partitionBy("ID", F.expr("floor(__us / 86400000000)")).orderBy("__us")
        times = times.withColumn("__dt", (F.col("__us") - F.lag("__us").over(within)) / 1e6)
        rate = 1 / F.percentile_approx(F.when(F.col("__dt") > 0, F.col("__dt")), 0.5, 1000)
        facts.append(F.coalesce(F.when(rate < 1, rate).otherwise(F.round(rate)) <= hz, F.lit(True)).alias("__own"))
    binned = data.join(times.groupBy("ID").agg(*facts), "ID").withColumn("__bin", F.floor((us - F.col("__t0")) * hz / 1e6).cast("bigint"))
    own = F.lit(False)
    if keep_slower:
        own = F.col("__own")
        binned = binned.withColumn("__bin", F.when(own, us - F.col("__t0")).otherwise(F.col("__bin")))
    out = binned.groupBy("ID", "__t0", own.alias("__own"), "__bin").agg(*[F.avg(c).alias(c) for c in linear], *[circular_mean(F.col(c), low).alias(c) for c, low in (circular or {}).items()], *[F.max(F.col(c).cast("int")).alias(c) for c in (flags or [])])
    stamp = F.timestamp_micros((F.col("__t0") + F.when(F.col("__own"), F.col("__bin")).otherwise(F.round(F.col("__bin") * (1e6 / hz)))).cast("bigint"))
    return out.select("ID", stamp.alias("datetime"), *linear, *(circular or {}), *(flags or []))


def epoch_bins(data: DataFrame, width_s: int, columns: list[str]) -> DataFrame:
    """Means per bin of whole seconds counted from the epoch; bins without a value are NULL."""
    bin_us = F.floor(F.unix_micros("datetime") / (width_s * 1_000_000)).cast("bigint") * (width_s * 1_000_000)
    return data.groupBy("ID", bin_us.alias("bin_us")).agg(*[F.avg(c).alias(c) for c in columns])


def weights(data: DataFrame, gap_factor: float = 5.0) -> DataFrame:
    """`data` with `weight_s`: the time until the record's next row. Gaps over `gap_factor` times the median gap,
    and the last row, weigh the median gap."""
    w = Window.partitionBy("ID").orderBy("datetime")
    gaps = data.withColumn("__gap", F.lead(seconds()).over(w) - seconds())
    usual = gaps.groupBy("ID").agg(F.percentile(F.when(F.col("__gap") > 0, F.col("__gap")), 0.5).alias("__usual"))
    plain = gaps.join(usual, "ID")
    return plain.withColumn("weight_s", F.when(F.col("__gap").isNull() | (F.col("__gap") > gap_factor * F.col("__usual")), F.col("__usual")).otherwise(F.col("__gap"))).drop("__gap", "__usual")


# Edges of the depth bins.
DEPTH_EDGES = [0, 1, 2, 5, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900, 1000]


def pretty(low: float, high: float, n: int = 5) -> list[float]:
    """About `n` intervals with round edges that cover the range."""
    if high <= low:
        return [low - 0.5, low + 0.5]
    raw = (high - low) / n
    power = 10 ** math.floor(math.log10(raw))
    step = min((m * power for m in (1, 2, 5, 10)), key=lambda s: abs(s - raw))
    a, b = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(k * step, 12) for k in range(a, b + 1)]


def edges(low: float, high: float, explicit: list[float] | None = None, width: float | None = None, n: int | None = None) -> list[float]:
    """Bin edges: given ones, multiples of a width, about n round ones, or the fixed depth edges."""
    if explicit:
        return sorted(set(explicit))
    if width:
        return [k * width for k in range(math.floor(low / width), math.ceil(high / width) + 1)]
    return pretty(low, high, n) if n else [float(e) for e in DEPTH_EDGES]


def bin_of(x: Column, breaks: list[float]) -> Column:
    """Number (from 1) of the bin that holds `x`; values beyond the ends fall into the end bins."""
    inner = breaks[1:-1]
    return F.when(x.isNotNull(), sum(((x >= F.lit(float(e))).cast("int") for e in inner), F.lit(1)))


def time_at(data: DataFrame, variable: str, breaks: list[float], phase: Column | None = None, gap_factor: float = 5.0) -> DataFrame:
    """Hours and share of each record's time in each bin of a variable: ``ID, variable, phase, bin, bin_min, bin_max,
    bin_mid, hours, pct``; only rows with a value take part."""
    w = weights(data.where(F.col(variable).isNotNull()), gap_factor).withColumn("phase", phase if phase is not None else F.lit("all")).withColumn("bin", bin_of(F.col(variable), breaks))
    hours = w.groupBy("ID", "phase", "bin").agg((F.sum("weight_s") / 3600).alias("hours"))
    total = Window.partitionBy("ID", "phase")
    lo, hi = (F.element_at(F.array(*[F.lit(float(e)) for e in part]), F.col("bin")) for part in (breaks[:-1], breaks[1:]))
    return hours.select("ID", F.lit(variable).alias("variable"), "phase", "bin", lo.alias("bin_min"), hi.alias("bin_max"), ((lo + hi) / 2).alias("bin_mid"), "hours", (100 * F.col("hours") / F.sum("hours").over(total)).alias("pct"))


def across_deployments(time_table: DataFrame, group: str | None = None) -> DataFrame:
    """Mean and standard error over deployments of the share per bin and phase."""
    keys = [*([group] if group else []), "variable", "phase", "bin", "bin_min", "bin_max"]
    return time_table.groupBy(*keys).agg(F.avg("pct").alias("mean_pct"), (F.stddev_samp("pct") / F.sqrt(F.count("pct"))).alias("se_pct"), F.count("pct").alias("k"))


def distributions(data: DataFrame, metrics: list[str]) -> DataFrame:
    """``ID, metric, n, mean, median, sd, q05, q25, q75, q95, min, max``; a metric without values has NULLs."""
    long = data.select("ID", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("p")).select("ID", "p.*")
    out = long.groupBy("ID", "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.percentile("x", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = [F.get("q", F.lit(k)) for k in range(5)]
    return out.select("ID", "metric", "n", "mean", q[2].alias("median"), "sd", q[0].alias("q05"), q[1].alias("q25"), q[3].alias("q75"), q[4].alias("q95"), "min", "max")


def pooled_reference(data: DataFrame, metric: str, trim: float = 0.99) -> DataFrame:
    """Pooled median, mean and upper trim quantile of a metric."""
    return data.agg(F.percentile(metric, 0.5).alias("median"), F.avg(metric).alias("mean"), F.percentile(metric, trim).alias("trim"))


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def footer(summary: DataFrame, columns: list[str], spread: str = "sd") -> DataFrame:
    """One row per column: mean and spread (``sd`` or ``se``) over the deployments."""
    long = summary.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*")
    width = F.stddev_samp("x") if spread == "sd" else standard_error(F.col("x"))
    return long.groupBy("variable").agg(F.avg("x").alias("mean"), width.alias(spread), F.count("x").alias("n"))


def deployment_summary(data: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """One row per deployment: length, rows, rate, depth, temperature, activity, vertical speed, fixes.

    Channels that the table lacks give NULL columns, so summaries of different fleets can be united.
    """

    def has(c: str) -> Column:
        return F.col(c) if c in data.columns else F.lit(None).cast("double")

    t = seconds()
    out = data.groupBy("ID").agg(
        F.min("datetime").alias("start"), F.max("datetime").alias("end"), ((F.max(t) - F.min(t)) / 3600).alias("duration_h"), F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / F.count_distinct(F.floor(t))).alias("sampling_hz"), F.avg(has("depth")).alias("depth_mean"), F.max(has("depth")).alias("depth_max"),
        F.avg(has("temp")).alias("temp_mean"), F.min(has("temp")).alias("temp_min"), F.max(has("temp")).alias("temp_max"),
        F.avg(has("vedba")).alias("vedba_mean"), F.avg(has("odba")).alias("odba_mean"), F.avg(has("speed")).alias("speed_mean"), F.max(has("speed")).alias("speed_max"),
        F.max(has("vertical_velocity")).alias("max_descent"), (-F.min(has("vertical_velocity"))).alias("max_ascent"),
        F.avg(has("tbf_hz_peaks")).alias("tbf_mean"), (100 * F.avg(has("tbf_swimming").cast("double"))).alias("pct_swimming"),
    )
    if fixes is None:
        return out.withColumn("n_fixes", F.lit(None).cast("bigint"))
    span = out.select("ID", "start", "end")
    counted = fixes.join(span, "ID").where(F.col("datetime").between(F.col("start"), F.col("end"))).groupBy("ID").agg(F.count(F.lit(1)).alias("n_fixes"))
    return out.join(counted, "ID", "left").withColumn("n_fixes", F.coalesce("n_fixes", F.lit(0)))


def with_covariates(summary: DataFrame, extra: DataFrame, columns: list[str]) -> DataFrame:
    """`summary` with the distinct values of each covariate, sorted and joined with ``/``."""
    one = extra.groupBy("ID").agg(*[F.concat_ws("/", F.array_sort(F.collect_set(F.col(c).cast("string")))).alias(c) for c in columns])
    return summary.join(one, "ID", "left")


def vertical_speed(data: DataFrame) -> DataFrame:
    """`data` with `vertical_velocity` (positive down): the central difference of depth in time."""
    from pelagia.operators.windows import central_rate

    w = Window.partitionBy("ID").orderBy("datetime")
    return data.withColumn("vertical_velocity", central_rate(F.col("depth"), seconds(), w))


def votes(proposals: DataFrame, group: str, family: str, mapping: str, min_agreement: float = 0.6, min_voters: int = 2) -> DataFrame:
    """Consensus per group and family: the most proposed mapping, its share, and a status.

    Status: ``none`` (no vote), ``insufficient`` (fewer voters than needed), ``agreed`` (all alike), ``majority``
    (share at least `min_agreement`), else ``conflict``. Of equally frequent mappings the smallest is named.
    """
    each = proposals.groupBy(group, family, mapping).agg(F.count(mapping).alias("v"))
    out = each.groupBy(group, family).agg(F.sum("v").alias("voters"), F.max("v").alias("top"), F.count(F.when(F.col("v") > 0, 1)).alias("kinds"), F.min_by(F.when(F.col("v") > 0, F.col(mapping)), F.struct(-F.col("v"), F.col(mapping))).alias("consensus"))
    agreement = F.when(F.col("voters") > 0, F.col("top") / F.col("voters"))
    status = F.when(F.col("voters") == 0, "none").when(F.col("voters") < min_voters, "insufficient").when(F.col("kinds") == 1, "agreed").when(agreement >= min_agreement, "majority").otherwise("conflict")
    return out.select(group, family, "voters", "consensus", agreement.alias("agreement"), status.alias("status"))


def impute_slopes(calibration: DataFrame, deployments: DataFrame, slope_range: tuple[float, float] = (0.0, 1e9), max_extrapolation: float = 5.0) -> DataFrame:
    """Paddle slopes for deployments by package and year.

    The rate of change per year is common to all packages (within-package weighted regression, not negative); a
    package's level is the weighted mean of its slopes without the rate. Sources: ``measured`` (this package and
    year), ``tag-model`` (the package's level plus the rate), ``baseline`` (the mean level of all packages).
    """
    one = calibration.where("slope is not null").withColumn("w", F.coalesce(F.col("r_squared"), F.lit(1.0))).groupBy("package_id", "year").agg((F.sum(F.col("slope") * F.col("w")) / F.sum("w")).alias("slope"), F.sum("w").alias("w"))
    mean = one.groupBy("package_id").agg((F.sum(F.col("year") * F.col("w")) / F.sum("w")).alias("ym"), (F.sum(F.col("slope") * F.col("w")) / F.sum("w")).alias("sm"), F.sum("w").alias("ww"))
    centred = one.join(mean, "package_id")
    dy, ds = F.col("year") - F.col("ym"), F.col("slope") - F.col("sm")
    rate = centred.agg(F.greatest(F.coalesce(F.try_divide(F.sum(F.col("w") * dy * ds), F.nullif(F.sum(F.col("w") * dy * dy), F.lit(0.0))), F.lit(0.0)), F.lit(0.0)).alias("rate"), (F.sum(F.col("slope") * F.col("w")) / F.sum("w")).alias("all_s"), (F.sum(F.col("year") * F.col("w")) / F.sum("w")).alias("all_y"))
    span = one.groupBy("package_id").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    # `rate` is one row by construction.
    d = deployments.join(one.select("package_id", "year", F.col("slope").alias("measured")), ["package_id", "year"], "left").join(mean.join(span, "package_id"), "package_id", "left").join(F.broadcast(rate))
    model = F.col("sm") + F.col("rate") * (F.col("year") - F.col("ym"))
    base = F.col("all_s") + F.col("rate") * (F.col("year") - F.col("all_y"))
    value = F.coalesce("measured", model, base)
    source = F.when(F.col("measured").isNotNull(), "measured").when(model.isNotNull(), "tag-model").otherwise("baseline")
    far = F.greatest(F.col("y0") - F.col("year"), F.col("year") - F.col("y1")) > max_extrapolation
    return d.select(*deployments.columns, F.greatest(F.least(value, F.lit(slope_range[1])), F.lit(slope_range[0])).alias("slope"), source.alias("source"), F.coalesce(far, F.lit(False)).alias("extrapolated"), F.col("rate"))


def safe_corr(a: Column, b: Column, least: int = 3) -> Column:
    """Aggregate: Pearson correlation of pairs, NULL under `least` pairs or without spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    n, sx, sy, sxx, syy, sxy = F.count(x), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= least) & (F.stddev_samp(x) >= 1e-9) & (F.stddev_samp(y) >= 1e-9), F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx * vy, F.lit(1e-300)))))
