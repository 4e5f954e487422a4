"""Dives: cohort settings, detection by hysteresis, phases, metrics with censoring.

Detection is made of window columns over one specification per record. Settings derived from the cohort
are the only thing that goes to the driver: a row of aggregates.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.control import DepthDrift, Dives
from pelagia.functions.angles import guarded_mean, resultant_length
from pelagia.grouped import numbers, over_sorted_groups
from pelagia.operators.tag import seconds
from pelagia.operators.windows import hysteresis, lookup, nocb, reverse, spec, with_runs

METRICS = ["start", "end", "duration_s", "max_depth", "mean_depth", "sd_depth", "baseline", "amplitude", "prominence", "n", "coverage", "descent_s", "bottom_s", "ascent_s", "descent_rate", "descent_rate_q90", "ascent_rate", "ascent_rate_q90", "bottom_mean", "bottom_sd", "vertical_m", "reversals", "truncated_start", "truncated_end", "n_gaps", "gap_s", "censored", "complete", "phase_structure", "shape_supported", "inter_dive_s", "inter_dive_censored"]


def scan(data: DataFrame) -> DataFrame:
    """Per ID what the settings are derived from: median step, noise, share of rows near the surface."""
    w = spec()
    t, d = seconds(), F.col("depth")
    second = d - 2 * F.lag(d).over(w) + F.lag(d, 2).over(w)
    steps = data.select("ID", "depth", (t - F.lag(t).over(w)).alias("dt"), second.alias("bend"))
    middle = steps.groupBy("ID").agg(F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("dt"), F.percentile("bend", 0.5).alias("mid"), F.avg((F.abs("depth") <= 0.5).cast("double")).alias("surface_share"), F.percentile(F.when(F.col("depth") < 2, F.abs("depth")), 0.95).alias("residual"))
    spread = steps.join(middle.select("ID", "mid"), "ID").groupBy("ID").agg((1.4826 * F.percentile(F.abs(F.col("bend") - F.col("mid")), 0.5) / (6.0**0.5)).alias("noise"))
    return middle.drop("mid").join(spread, "ID", "left")


def settings(scanned: DataFrame, control: Dives, bin_s: float = 1.0) -> Dives:
    """The control with what it leaves open filled in from the cohort's worst record (one row is collected)."""
    row = scanned.agg(F.max("residual").alias("residual"), F.max("noise").alias("noise"), F.max("dt").alias("dt")).first()
    residual, noise, dt = row["residual"], row["noise"] or 0.0, row["dt"] or 1.0
    threshold = control.threshold or max(3 * residual if residual else 3 * 0.34, 1.0)
    band = control.band or max(2 * residual if residual else 0.5, threshold / 10, 0.5)
    if band >= threshold:
        band = threshold / 2
    return replace(
        control, threshold=threshold, band=band, min_amplitude=threshold - band if control.min_amplitude is None else control.min_amplitude,
        min_duration_s=max(4 * bin_s, 4 * dt, 10.0) if control.min_duration_s is None else control.min_duration_s,
        max_gap_s=max(60.0, 10 * dt) if control.max_gap_s is None else control.max_gap_s, wiggle=max(0.5, 3 * noise) if control.wiggle is None else control.wiggle,
    )


def running_baseline(data: DataFrame, hours: float) -> DataFrame:
    """`data` with `depth_baseline`: medians of blocks of half the window, combined with the two neighbours and
    interpolated in time between block centres. Only block medians are windowed, not rows with wide frames."""
    half = max(hours * 1800.0, 1.0)
    blocks = data.where("depth is not null").withColumn("b", F.floor(seconds() / half).cast("bigint")).groupBy("ID", "b").agg(F.percentile("depth", 0.5).alias("m"))
    w = Window.partitionBy("ID").orderBy("b")
    smooth = blocks.select("ID", "b", F.least("m", F.coalesce(F.percentile("m", 0.5).over(w.rowsBetween(-1, 1)), F.col("m"))).alias("m"))
    smooth = smooth.withColumn("m2", F.coalesce(F.lead("m").over(w), F.col("m"))).withColumn("b2", F.coalesce(F.lead("b").over(w), F.col("b") + 1))
    x = seconds() / half - 0.5
    met = data.withColumn("b", F.floor(x).cast("bigint")).join(smooth, ["ID", "b"], "left")
    first = smooth.groupBy("ID").agg(F.min_by("m", "b").alias("m_first"))
    met = met.join(first, "ID", "left")
    return met.withColumn("depth_baseline", F.coalesce(F.col("m") + (F.col("m2") - F.col("m")) * (x - F.col("b")) / (F.col("b2") - F.col("b")), F.col("m_first"))).drop("b", "m", "m2", "b2", "m_first")


def detect(data: DataFrame, control: Dives | dict | None = None, bin_s: float = 1.0) -> tuple[DataFrame, Dives]:
    """`data` with `dive_id` (0: none), `dive_phase` and `depth_baseline`, and the settings used.

    A dive is a run in which depth below the reference rose over the threshold and has not yet fallen under
    the band; time gaps and runs without depth longer than `max_gap_s` end it. Fragments under the least
    amplitude or duration are no dives. Records without depth have dive_id 0 everywhere. With `reference`
    ``auto`` a record is measured from the surface if at least half a percent of it lies there, else from
    its running baseline. `direction` ``both`` also finds runs above the baseline.
    """
    c = Dives.of(control)
    scanned = scan(data)
    s = settings(scanned, c, bin_s)
    if s.reference == "surface":
        ref = data.withColumn("depth_baseline", F.lit(0.0))
    else:
        ref = running_baseline(data, s.baseline_hours)
        if s.reference == "auto":
            ref = ref.join(scanned.select("ID", F.coalesce(F.col("surface_share") >= 0.005, F.lit(False)).alias("__anchored")), "ID", "left").withColumn("depth_baseline", F.when(F.col("__anchored"), 0.0).otherwise(F.col("depth_baseline"))).drop("__anchored")
    w = spec()
    t = seconds()
    signs = {"down": (1,), "up": (-1,), "both": (1, -1)}[s.direction]
    df = ref.withColumn("__r", F.col("depth") - F.col("depth_baseline")).withColumn("__t", t)
    known_before = F.last(F.when(F.col("depth").isNotNull(), F.col("__t")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known_behind = nocb(F.when(F.col("depth").isNotNull(), F.col("__t")))
    df = df.withColumn("__dark", F.col("depth").isNull() & F.coalesce(known_behind - known_before > s.max_gap_s, F.lit(True)))
    df = df.withColumn("__split", F.coalesce(F.col("__t") - F.lag("__t").over(w) > s.max_gap_s, F.lit(True)))
    state = F.lit(0)
    for sign in signs:
        state = F.when(hysteresis(F.col("__r") * sign, F.lit(s.threshold), F.lit(s.band), w) == 1, F.lit(sign)).otherwise(state)
    df = df.withColumn("__state", F.when(F.col("__dark"), 0).otherwise(state))
    # The dive begins where the series left the band, so rows over the band before the threshold belong to it.
    over = F.lit(0)
    for sign in signs:
        over = F.when(F.col("__r") * sign >= s.band, F.lit(sign)).otherwise(over)
    df = df.withColumn("__over", F.when(F.col("__dark"), 0).when(F.col("depth").isNull(), F.coalesce(F.last(F.when(F.col("depth").isNotNull(), over), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).otherwise(over))
    changed = (F.row_number().over(w) == 1) | (F.col("__over") != F.lag("__over").over(w)) | F.col("__split")
    df = df.withColumn("__run", F.sum(F.when(changed, 1).otherwise(0)).over(w))
    if s.prominence is not None:
        df = split_at_cols(df, s.prominence)
    per = Window.partitionBy("ID", "__run")
    keep = (F.col("__over") != 0) & (F.max(F.abs("__r")).over(per) > s.threshold) & (F.max(F.abs("__r")).over(per) - s.band >= s.min_amplitude - 1e-9) & (F.max("__t").over(per) - F.min("__t").over(per) >= s.min_duration_s)
    df = df.withColumn("__dive", F.coalesce(keep, F.lit(False)))
    begins = F.col("__dive") & ((F.row_number().over(w) == 1) | (F.col("__run") != F.lag("__run").over(w)))
    df = df.withColumn("dive_id", F.when(F.col("__dive"), F.sum(begins.cast("int")).over(w)).otherwise(0).cast("int"))
    if s.phase_method == "vertical_rate":
        df = rate_phases(df, s)
    else:
        dive = Window.partitionBy("ID", "dive_id")
        deep = F.abs(F.col("__r")) >= s.bottom_share * F.max(F.abs("__r")).over(dive)
        first, last = F.min(F.when(deep, F.col("__t"))).over(dive), F.max(F.when(deep, F.col("__t"))).over(dive)
        df = df.withColumn("dive_phase", F.when(F.col("dive_id") == 0, "inter_dive").when(F.col("__t") < first, "descent").when(F.col("__t") > last, "ascent").otherwise("bottom"))
    return df.select(*data.columns, "depth_baseline", "dive_id", "dive_phase"), s


def rate_phases(df: DataFrame, s: Dives) -> DataFrame:
    """`df` (with ``dive_id, __r, __t``) with `dive_phase` by the vertical rate.

    A rate counts as moving if it is over `rate_share` of the dive's own `rate_quantile` quantile of absolute rates.
    Descent ends where, after it has begun and before the deepest row, the animal first does not descend for a
    sustained run (a twentieth of the dive's rows, three at least), else before the deepest row; ascent begins with the
    first sustained run of ascending rows behind it. Dives of fewer than three rows, and without any rate, are bottom.
    """
    dive = Window.partitionBy("ID", "dive_id")
    w = dive.orderBy("__t")
    inside = F.col("dive_id") > 0
    z, dt = F.abs("__r"), F.col("__t") - F.lag("__t").over(w)
    df = df.withColumn("__v", F.when(inside & (dt > 0), (z - F.lag(z).over(w)) / dt)).withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(dive))
    df = df.withColumn("__crit", s.rate_share * F.percentile(F.when(inside, F.abs("__v")), s.rate_quantile).over(dive))
    df = df.withColumn("__peak", F.min_by("__i", F.struct(-z, F.col("__i"))).over(dive)).withColumn("__long", F.greatest(F.lit(3), F.ceil(0.05 * F.col("__n"))))
    df = df.withColumn("__began", F.min(F.when((F.col("__i") < F.col("__peak")) & (F.col("__v") > F.col("__crit")), F.col("__i"))).over(dive))
    side = F.when((F.col("__i") < F.col("__peak")) & (F.col("__i") > F.col("__began")), 1).when(F.col("__i") > F.col("__peak"), 2).otherwise(0)
    holds = F.when(side == 1, F.col("__v") <= F.col("__crit")).when(side == 2, F.col("__v") < -F.col("__crit"))
    df = df.withColumn("__key", side * 2 + F.coalesce(holds, F.lit(False)).cast("int"))
    df = df.withColumn("__stretch", F.sum(F.when(F.col("__key") == F.lag("__key").over(w), 0).otherwise(1)).over(w))
    run = Window.partitionBy("ID", "dive_id", "__stretch")
    df = df.withColumn("__held", (F.count(F.lit(1)).over(run) >= F.col("__long")) & F.col("__key").isin(3, 5))
    slow, up = (F.min(F.when(F.col("__held") & (F.col("__key") == k), F.col("__i"))).over(dive) for k in (3, 5))
    down_to = F.when(F.col("__began").isNotNull() & (F.col("__peak") - 1 >= F.col("__long")), F.coalesce(slow, F.col("__peak")) - 1)
    up_from = F.when(F.col("__n") - F.col("__peak") >= F.col("__long"), up)
    moving = (F.col("__n") >= 3) & (F.col("__crit") > 0)
    df = df.withColumn("dive_phase", F.when(F.col("dive_id") == 0, "inter_dive").when(moving & (F.col("__i") <= down_to), "descent").when(moving & (F.col("__i") >= up_from), "ascent").otherwise("bottom"))
    return df.drop("__v", "__i", "__n", "__crit", "__peak", "__long", "__began", "__key", "__stretch", "__held")


def cols(z: np.ndarray, prominence: float, most: int = 64) -> list[int]:
    """Where a run is divided: at the lowest point between two peaks that both rise at least `prominence` above it, the most
    prominent first, and so on in the parts."""
    out: list[int] = []
    parts = [(0, len(z))]
    while parts and len(out) < most:
        a, b = parts.pop()
        if b - a < 3:
            continue
        x = z[a:b]
        left, right = np.maximum.accumulate(x), np.maximum.accumulate(x[::-1])[::-1]
        depth = np.minimum(left, right) - x
        k = int(np.argmax(depth))
        if depth[k] >= prominence:
            out.append(a + k)
            parts += [(a, a + k), (a + k + 1, b)]
    return sorted(out)


def split_at_cols(df: DataFrame, prominence: float) -> DataFrame:
    """`df` (with ``__r, __run, __over``) with runs divided at their cols. A kernel sees one run of one record at a time."""
    w = spec()
    over = df.where("__over <> 0 and __r is not null").select("ID", "__run", F.unix_micros("datetime").alias("__us"), F.abs("__r").alias("__z"))

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        z, us = numbers(table, "__z").astype(float), numbers(table, "__us")
        at = [a + k for a, b in zip(starts.tolist(), np.r_[starts[1:], len(z)].tolist()) for k in cols(z[a:b], prominence)]
        take = pa.array(at, pa.int64())
        return pa.table({"ID": table.column("ID").take(take), "__us": pa.array(us[at] if at else np.zeros(0, np.int64))})

    cut = over_sorted_groups(over, ["ID", "__run"], ["__us"], kernel, "ID string, __us bigint").withColumn("__cut", F.lit(1))
    met = df.withColumn("__us", F.unix_micros("datetime")).join(cut, ["ID", "__us"], "left")
    # A col ends its part: the row behind it begins the next run.
    behind = F.coalesce(F.lag("__cut").over(w), F.lit(0))
    new = (F.row_number().over(w) == 1) | (F.col("__run") != F.lag("__run").over(w)) | (behind == 1)
    return met.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w)).drop("__new", "__cut", "__us")


def metrics(dives: DataFrame, s: Dives, variables: tuple[str, ...] = (), circular: tuple[str, ...] = ()) -> DataFrame:
    """One row per dive: ``ID, dive_id`` and the columns of `METRICS`, plus mean and sd of each variable.

    A phase counts if it has two rows at different times; with fewer than two phases that count, durations and rates of
    phases, bottom figures and reversals are NULL (the structure then is the one letter, or X). Reversals are changes of
    direction by moves of at least the wiggle. A dive is censored at a boundary of the record, or by interruptions:
    time steps over `max_gap_s`, and runs without depth that last longer, inside it or at its edges. Each edge is
    charged the longer of the two. The interval to the next dive is censored if an interruption lies in it. The schema
    does not depend on whether there are dives.
    """
    w = spec()
    t = seconds()
    same = F.lag("dive_id").over(w) == F.col("dive_id")
    df = dives.withColumn("__t", t).withColumn("__dark", F.col("depth").isNull())
    df = with_runs(df, ["__dark"], name="__run")
    per = Window.partitionBy("ID", "__run")
    length = F.max("__t").over(per) - F.min("__t").over(per)
    df = df.withColumn("__span", F.when(F.col("__dark") & (length > s.max_gap_s), length).otherwise(0.0))
    everything = Window.partitionBy("ID")
    step, ahead = F.col("__t") - F.lag("__t").over(w), F.lead("__t").over(w) - F.col("__t")
    df = df.select("*", step.alias("__dt"), F.when(same, F.col("depth") - F.lag("depth").over(w)).alias("__dz"), F.when(same, step).alias("__inner"), ahead.alias("__ahead"), F.lag("__span").over(w).alias("__span0"), F.lead("__span").over(w).alias("__span1"), F.min("__t").over(everything).alias("__first"), F.max("__t").over(everything).alias("__last"))
    broken = (F.coalesce(F.col("__dt") > s.max_gap_s, F.lit(False)) | ((F.col("__span") > 0) & (F.coalesce(F.col("__span0"), F.lit(0.0)) == 0))).cast("int")
    df = df.withColumn("__gaps", F.sum(broken).over(w))
    rate = F.try_divide("__dz", F.nullif(F.col("__inner"), F.lit(0.0)))
    df = df.withColumn("__v", rate).withColumn("__opens", F.col("__inner").isNull())
    closes = ~F.coalesce(F.lead("dive_id").over(w) == F.col("dive_id"), F.lit(False))
    df = df.withColumn("__closes", closes)

    def over_limit(x):
        return F.when(x > s.max_gap_s, x).otherwise(0.0)

    edge0, edge1 = F.greatest(over_limit(F.col("__dt")), F.coalesce(F.col("__span0"), F.lit(0.0))), F.greatest(over_limit(F.col("__ahead")), F.coalesce(F.col("__span1"), F.lit(0.0)))
    inner = over_limit(F.col("__inner"))
    dark_run = F.when(F.col("__span") > 0, F.struct("__run", "__span"))
    r = F.abs(F.col("depth") - F.col("depth_baseline"))
    at = F.struct(F.col("__t").alias("t"), F.col("depth").alias("z"))

    def phase(name: str, x):
        return F.when(F.col("dive_phase") == name, x)

    def span(name: str):
        return F.when(F.count(phase(name, F.col("__t"))) >= 2, F.max(phase(name, F.col("__t"))) - F.min(phase(name, F.col("__t")))).otherwise(0.0)

    def q90(name: str):
        return F.percentile(phase(name, F.abs("__v")), 0.9)

    extra = [a for v in variables for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))] + [a for v in circular for a in (guarded_mean(F.col(v)).alias(f"{v}_mean"), resultant_length(F.col(v)).alias(f"{v}_mrl"))]
    known = F.when(F.col("depth").isNotNull(), F.col("__t"))
    out = df.where("dive_id > 0").groupBy("ID", "dive_id").agg(
        F.min("__t").alias("start"), F.max("__t").alias("end"), (F.max("__t") - F.min("__t")).alias("duration_s"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.stddev_samp("depth").alias("sd_depth"),
        F.min_by("depth_baseline", "__t").alias("baseline"), F.max(r).alias("amplitude"), (F.max(r) - F.greatest(F.min_by(r, known), F.max_by(r, known))).alias("prominence"), F.count(F.lit(1)).alias("n"), F.avg(F.col("depth").isNotNull().cast("double")).alias("coverage"),
        span("descent").alias("descent_s"), span("bottom").alias("bottom_s"), span("ascent").alias("ascent_s"),
        F.avg(phase("descent", F.col("__v"))).alias("descent_rate"), q90("descent").alias("descent_rate_q90"), F.avg(phase("ascent", F.col("__v"))).alias("ascent_rate"), q90("ascent").alias("ascent_rate_q90"),
        F.avg(phase("bottom", F.col("depth"))).alias("bottom_mean"), F.stddev_samp(phase("bottom", F.col("depth"))).alias("bottom_sd"),
        F.coalesce(F.sum(F.abs("__dz")), F.lit(0.0)).alias("vertical_m"), reversals(F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), at))), s.wiggle or 0.5).alias("reversals"),
        F.bool_or(F.col("__t") == F.col("__first")).alias("truncated_start"), F.bool_or(F.col("__t") == F.col("__last")).alias("truncated_end"),
        F.sum(inner).alias("__in"), F.count_if(inner > 0).alias("__in_n"), F.collect_set(dark_run).alias("__darks"),
        F.max(F.when(F.col("__opens"), edge0)).alias("__e0"), F.max(F.when(F.col("__closes"), edge1)).alias("__e1"),
        F.bool_or((inner > 0) | F.coalesce(F.col("__opens") & (F.col("__dt") > s.max_gap_s), F.lit(False)) | F.coalesce(F.col("__closes") & (F.col("__ahead") > s.max_gap_s), F.lit(False))).alias("__time"),
        F.bool_or((F.col("__span") > 0) | F.coalesce(F.col("__opens") & (F.col("__span0") > 0), F.lit(False)) | F.coalesce(F.col("__closes") & (F.col("__span1") > 0), F.lit(False))).alias("__lost"),
        F.bool_or(F.col("__closes") & F.coalesce(F.col("__ahead") > s.max_gap_s, F.lit(False))).alias("__behind"), F.max("__gaps").alias("__gaps"), F.min("__gaps").alias("__gaps0"), *extra,
    )
    # A gap of zero rows is no interruption; of those inside, each run without depth is charged once.
    dark = F.aggregate("__darks", F.lit(0.0), lambda a, x: a + x["__span"])
    out = out.withColumn("gap_s", F.col("__in") + dark + F.coalesce("__e0", F.lit(0.0)) + F.coalesce("__e1", F.lit(0.0))).withColumn("n_gaps", F.col("__in_n") + F.size("__darks") + (F.coalesce("__e0", F.lit(0.0)) > 0).cast("int") + (F.coalesce("__e1", F.lit(0.0)) > 0).cast("int"))
    edge = F.col("truncated_start") | F.col("truncated_end")
    kinds = edge.cast("int") + F.col("__time").cast("int") + F.col("__lost").cast("int")
    out = out.withColumn("censored", F.when(kinds > 1, "mixed").when(edge, "boundary").when(F.col("__time"), "time_gap").when(F.col("__lost"), "depth_gap").otherwise("none")).withColumn("complete", F.col("censored") == "none")
    shape = (F.col("descent_s") > 0).cast("int") + (F.col("bottom_s") > 0).cast("int") + (F.col("ascent_s") > 0).cast("int")
    letters = F.concat(*[F.when(F.col(f"{p}_s") > 0, c).otherwise("") for p, c in (("descent", "D"), ("bottom", "B"), ("ascent", "A"))])
    out = out.withColumn("phase_structure", F.when(letters == "", "X").otherwise(letters)).withColumn("shape_supported", shape >= 2)
    only = ["descent_rate", "descent_rate_q90", "ascent_rate", "ascent_rate_q90", "reversals"]
    out = out.withColumns({c: F.when(F.col("shape_supported") & (F.col("bottom_s") > 0), F.col(c)) for c in ("bottom_mean", "bottom_sd")})
    out = out.withColumns({c: F.when(F.col("shape_supported"), F.col(c)) for c in [*only, "descent_s", "bottom_s", "ascent_s"]})
    nxt = Window.partitionBy("ID").orderBy("dive_id")
    out = out.withColumn("inter_dive_s", F.lead("start").over(nxt) - F.col("end")).withColumn("inter_dive_censored", F.when(F.lead("start").over(nxt).isNotNull(), (F.lead("__gaps0").over(nxt) > F.col("__gaps"))))
    more = [f"{v}_{m}" for v in variables for m in ("mean", "sd")] + [f"{v}_{m}" for v in circular for m in ("mean", "mrl")]
    return out.select("ID", "dive_id", *METRICS, *more)


def reversals(points, least: float):
    """Changes of direction in an array of ``(t, z)`` in time order: a turning point counts once the move away from it is at
    least `least`. The array is one dive's."""
    start = F.struct(F.lit(0).alias("n"), F.get(points, F.lit(0))["z"].alias("last"), F.lit(0).alias("way"))

    def walk(a, p):
        way = F.signum(p["z"] - a["last"]).cast("int")
        moved = F.abs(p["z"] - a["last"]) >= least
        turned = moved & (a["way"] != 0) & (way != a["way"])
        return F.struct((a["n"] + turned.cast("int")).alias("n"), F.when(moved, p["z"]).otherwise(a["last"]).alias("last"), F.when(moved, way).otherwise(a["way"]).alias("way"))

    return F.aggregate(points, start, walk, lambda a: a["n"])


def per_deployment(dive_table: DataFrame) -> DataFrame:
    """Number of dives, median and maximum duration (minutes) and depth, incomplete, truncated and gapped ones."""
    return dive_table.groupBy("ID").agg(
        F.count(F.lit(1)).alias("n_dives"), (F.percentile("duration_s", 0.5) / 60).alias("duration_median_min"), (F.max("duration_s") / 60).alias("duration_max_min"),
        F.percentile("max_depth", 0.5).alias("depth_median"), F.max("max_depth").alias("depth_max_dive"), F.count_if(~F.col("complete")).alias("n_incomplete"),
        F.count_if(F.col("truncated_start") | F.col("truncated_end")).alias("n_truncated"), F.count_if(F.col("gap_s") > 0).alias("n_gapped"),
    )


def usable(metric: str):
    """Which dives count for a metric: ``used``, ``censored`` or ``unsupported`` (no value)."""
    ok = (~F.coalesce(F.col("inter_dive_censored"), F.lit(True))) if metric == "inter_dive_s" else F.col("complete")
    return F.when(F.col(metric).isNull(), "unsupported").when(ok, "used").otherwise("censored")


def plot_summary(dive_table: DataFrame, metric: str) -> DataFrame:
    """Per ID how many dives count for a metric, and the distribution of those that do."""
    kind = dive_table.withColumn("__u", usable(metric)).withColumn("__x", F.when(F.col("__u") == "used", F.col(metric)))
    q = F.percentile("__x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return kind.groupBy("ID").agg(F.count(F.lit(1)).alias("n_dives"), F.count_if(F.col("__u") == "used").alias("n_used"), F.count_if(F.col("__u") == "censored").alias("n_censored"), F.count_if(F.col("__u") == "unsupported").alias("n_unsupported"), q.alias("q"), F.min("__x").alias("min"), F.max("__x").alias("max")).select("ID", "n_dives", "n_used", "n_censored", "n_unsupported", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(2)).alias("q75"), "min", "max")


def attenuation(duration_s, bin_s: float):
    """Share of a dive's depth that remains after averaging over bins of `bin_s` seconds."""
    full = F.when(duration_s >= 2 * bin_s, 1 - bin_s / duration_s).otherwise(duration_s / (4 * bin_s))
    return F.greatest(F.least(full, F.lit(1.0)), F.lit(0.0))


def sensitivity(data: DataFrame, thresholds: list[float]) -> DataFrame:
    """Dives by naive crossing of each threshold, per ID: how much a count depends on it."""
    w = spec()
    rows = data.where("depth is not null").withColumn("__p", F.lag("depth").over(w))
    counted = rows.groupBy("ID").agg(*[F.count_if((F.col("depth") > h) & ((F.col("__p") <= h) | F.col("__p").isNull())).alias(f"h{n}") for n, h in enumerate(thresholds)])
    return counted.select("ID", F.explode(F.array(*[F.struct(F.lit(float(h)).alias("threshold"), F.col(f"h{n}").alias("n_dives")) for n, h in enumerate(thresholds)])).alias("x")).select("ID", "x.*")


def zero_offset(data: DataFrame, dry: DataFrame, control: DepthDrift | dict | None = None) -> DataFrame:
    """`data` with `depth_corrected` and `drift_status` from dry intervals (``ID, start, end``).

    The depth in each dry interval of at least `min_dry_s` is an anchor (its median) if it lies within `band` of
    the record's 5 % quantile. With fewer than `min_anchors` their median is taken off; otherwise the offset is
    linear between anchors and constant beyond. Without any anchor depth stays (``abstained``).
    """
    from pelagia.operators.joins import in_intervals

    c = DepthDrift.of(control)
    band, min_dry_s, min_anchors, max_gap_s = c.band, c.min_dry_s, c.min_anchors, c.max_gap_s
    low = data.groupBy("ID").agg(F.percentile("depth", 0.05).alias("__q05"))
    spans = dry.where(F.unix_micros("end") - F.unix_micros("start") >= min_dry_s * 1e6).select("ID", "start", "end")
    wet = in_intervals(data.where("depth is not null"), spans.withColumn("__begin", F.col("start")), ["ID"], "start", "end", carry=["__begin"])
    anchors = wet.groupBy("ID", "__begin").agg(F.percentile("depth", 0.5).alias("__o"), F.avg(seconds()).alias("__at")).join(low, "ID").where(F.col("__o") <= F.col("__q05") + band)
    many = anchors.groupBy("ID").agg(F.count(F.lit(1)).alias("__n"), F.percentile("__o", 0.5).alias("__mid"))
    w = Window.partitionBy("ID").orderBy("__s")
    marks = anchors.select("ID", F.col("__at").alias("__s"), F.col("__o").alias("__anchor"), F.lit(None).alias("__row"))
    rows = data.select("ID", seconds().alias("__s"), F.lit(None).cast("double").alias("__anchor"), F.struct(*data.columns).alias("__row"))
    both = rows.unionByName(marks)
    back = reverse(("ID",), ("__s",))
    line = lookup(F.col("__anchor"), F.col("__s"), w, back)
    before = F.last(F.when(F.col("__anchor").isNotNull(), F.col("__s")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = nocb(F.when(F.col("__anchor").isNotNull(), F.col("__s")), back)
    met = both.withColumn("__off", line).withColumn("__wide", behind - before).where("__row is not null").select("ID", "__row", "__off", "__wide").join(many, "ID", "left")
    offset = F.when(F.col("__n") >= min_anchors, F.col("__off")).otherwise(F.col("__mid"))
    status = F.when(F.col("__n").isNull(), "abstained").when(F.col("__n") < min_anchors, "constant_offset").when(F.max("__wide").over(Window.partitionBy("ID")) > max_gap_s, "applied_with_gaps").otherwise("applied")
    return met.withColumn("depth_corrected", F.col("__row.depth") - F.coalesce(offset, F.lit(0.0))).withColumn("drift_status", status).select("__row.*", "depth_corrected", "drift_status")
