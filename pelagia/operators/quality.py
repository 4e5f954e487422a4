"""Sensor integrity, sensor quality, deployment metadata: checks that return typed issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.control import Anomaly, Integrity
from pelagia.functions.names import tidy
from pelagia.operators.aggregates import safe_corr
from pelagia.operators.tag import seconds
from pelagia.operators.windows import spec, with_runs

FAMILIES = {"accel": ["ax", "ay", "az"], "gyro": ["gx", "gy", "gz"], "mag": ["mx", "my", "mz"]}
RANK = {"info": 1, "warning": 2, "error": 3}


def grade(value: Column, warn: float, error: float) -> Column:
    """``error`` or ``warning`` for values strictly above the limits, else NULL."""
    return F.when(value > error, "error").when(value > warn, "warning")


def rank(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), severity), F.lit(0))


def _issue(check: str, channel, severity: Column, value: Column) -> Column:
    """An issue struct, NULL where there is none."""
    name = F.lit(channel) if isinstance(channel, str) else channel
    return F.when(severity.isNotNull(), F.struct(F.lit(check).alias("check"), name.alias("channel"), severity.alias("severity"), F.round(value, 6).alias("value")))


def integrity_metrics(data: DataFrame) -> DataFrame:
    """One row per ID with what the checks look at, in one aggregation and one join for shares at the extremes."""
    have = [c for cs in FAMILIES.values() for c in cs if c in data.columns]
    others = [c for c in ("temp", "depth") if c in data.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in [*have, *others]:
        aggs += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for fam in ("gyro", "mag"):
        for a, b in zip(FAMILIES["accel"], FAMILIES[fam]):
            if a in have and b in have:
                aggs += [safe_corr(F.col(a), F.col(b), 10).alias(f"corr_{b}")]
    if set(FAMILIES["accel"]) <= set(have):
        aggs += [F.percentile(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), 0.5).alias("accel_size")]
    for c in FAMILIES["gyro"]:
        if c in have:
            aggs += [F.percentile(c, 0.5).alias(f"bias_{c}")]
    if set(FAMILIES["mag"]) <= set(have):
        for c in FAMILIES["mag"]:
            aggs += [F.percentile(c, F.array(F.lit(0.02), F.lit(0.98))).alias(f"iron_{c}")]
    base = data.groupBy("ID").agg(*aggs)
    met = data.join(base.select("ID", *[f"{m}_{c}" for c in have for m in ("min", "max")], *([f"iron_{c}" for c in FAMILIES["mag"]] if set(FAMILIES["mag"]) <= set(have) else [])), "ID")
    ends = [F.greatest(F.count_if(F.col(c) == F.col(f"min_{c}")), F.count_if(F.col(c) == F.col(f"max_{c}"))).alias(f"ends_{c}") for c in have]
    if set(FAMILIES["mag"]) <= set(have):
        radius = F.sqrt(sum(((F.col(c) - (F.get(f"iron_{c}", F.lit(0)) + F.get(f"iron_{c}", F.lit(1))) / 2) ** 2 for c in FAMILIES["mag"]), F.lit(0.0)))
        ends += [F.percentile(radius, 0.5).alias("mag_radius"), F.percentile(radius, F.array(F.lit(0.25), F.lit(0.75))).alias("mag_q")]
    return base.join(met.groupBy("ID").agg(*ends), "ID", "left")


def check_integrity(data: DataFrame, control: Integrity | dict | None = None) -> DataFrame:
    """Issues ``ID, check, channel, severity, value`` of duplicated, dead, saturated, implausible, badly scaled,
    biased and missing sensors; a typed empty table if there are none."""
    c = Integrity.of(control)
    m = integrity_metrics(data)
    cols = set(m.columns)
    found: list[Column] = []
    for fam in ("gyro", "mag"):
        names = [f"corr_{x}" for x in FAMILIES[fam]]
        if set(names) <= cols:
            least = F.least(*[F.abs(n) for n in names])
            found.append(_issue("duplication", fam, F.when(F.expr(" and ".join(f"{n} is not null" for n in names)) & (least > c.duplicate_corr), "error"), least))
    for ch in [*(x for f in FAMILIES.values() for x in f), "temp"]:
        if f"n_{ch}" in cols:
            width = F.col(f"max_{ch}") - F.col(f"min_{ch}")
            found.append(_issue("dead", ch, F.when((F.col(f"n_{ch}") >= 10) & (width < c.dead_range), "error"), width))
            missing = 1 - F.col(f"n_{ch}") / F.col("rows")
            found.append(_issue("dropout", ch, F.when((missing > c.dropout) & (F.col(f"n_{ch}") > 0), "warning"), missing))
        if f"ends_{ch}" in cols:
            share = F.try_divide(F.col(f"ends_{ch}"), F.nullif(F.col(f"n_{ch}"), F.lit(0)))
            alive = F.col(f"max_{ch}") - F.col(f"min_{ch}") >= c.dead_range
            found.append(_issue("saturation", ch, F.when((F.col(f"n_{ch}") >= 50) & alive, grade(share, *c.saturation)), share))
    if "accel_size" in cols:
        off = F.abs(F.col("accel_size") - 1)
        found.append(_issue("accel_scale", "accel", grade(off, *c.accel_scale), off))
    for ch in FAMILIES["gyro"]:
        if f"bias_{ch}" in cols:
            found.append(_issue("gyro_bias", ch, F.when(F.abs(f"bias_{ch}") > 0.1, "info"), F.col(f"bias_{ch}")))
    if "mag_radius" in cols:
        spread = F.try_divide((F.get("mag_q", F.lit(1)) - F.get("mag_q", F.lit(0))) * 0.7413, F.nullif(F.col("mag_radius"), F.lit(0.0)))
        found.append(_issue("mag_plausibility", "mag", F.when(spread > c.mag_cv, "warning"), spread))
    return m.select("ID", F.explode(F.array_compact(F.array(*found))).alias("x")).select("ID", "x.*")


def mag_breaks(data: DataFrame, control: Integrity | dict | None = None) -> DataFrame:
    """Advisory: a step in field strength. Medians of ten minutes; for every split the share of pairs (before,
    behind) in rising order. Rows ``ID, at_us, auc, step`` for IDs whose best split is beyond the limits.

    A pair count is built from ranks: the sum of the later part's ranks gives it without comparing pairs.
    """
    c = Integrity.of(control)
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    bins = data.withColumn("__f", size).where("__f is not null").groupBy("ID", F.floor(F.unix_micros("datetime") / 600_000_000).cast("bigint").alias("b")).agg(F.percentile("__f", 0.5).alias("f"))
    byf, byb = Window.partitionBy("ID").orderBy("f"), Window.partitionBy("ID").orderBy("b")
    everything = Window.partitionBy("ID")
    n = F.count(F.lit(1)).over(everything)
    ties = F.count(F.lit(1)).over(Window.partitionBy("ID", "f"))
    ranked = bins.withColumn("n", n).where(F.col("n") >= c.mag_break_windows).withColumn("r", F.rank().over(byf) + (ties - 1) / 2)
    w = byb.rowsBetween(Window.unboundedPreceding, -1)
    split = ranked.withColumn("n1", F.count(F.lit(1)).over(w)).withColumn("r1", F.sum("r").over(w)).withColumn("m1", F.avg("f").over(w)).withColumn("all_f", F.sum("f").over(everything)).withColumn("m2", (F.col("all_f") - F.col("m1") * F.col("n1")) / F.nullif(F.col("n") - F.col("n1"), F.lit(0))).where("n1 >= 5 and n - n1 >= 5")
    n2 = F.col("n") - F.col("n1")
    u = (F.col("n") * (F.col("n") + 1) / 2 - F.col("r1")) - n2 * (n2 + 1) / 2
    auc = u / (F.col("n1") * n2)
    best = split.withColumn("auc", F.greatest(auc, 1 - auc)).groupBy("ID").agg(F.max_by(F.struct("b", "auc", "m1", "m2"), F.struct("auc", -F.col("b"))).alias("x")).select("ID", "x.*")
    step = F.abs(F.col("m2") - F.col("m1")) / F.greatest(F.abs("m1"), F.lit(1e-9))
    return best.select("ID", (F.col("b") * 600_000_000).alias("at_us"), "auc", step.alias("step")).where((F.col("auc") > c.mag_break_auc) & (F.col("step") >= c.mag_break_step))


def drop_failed(data: DataFrame, issues: DataFrame, severity: str = "error") -> DataFrame:
    """`data` with the channels NULL that an issue of at least `severity` names (families count for their axes)."""
    bad = issues.where(rank(F.col("severity")) >= RANK[severity]).groupBy("ID").agg(F.collect_set("channel").alias("__bad"))
    met = data.join(bad, "ID", "left")
    family = {c: f for f, cs in FAMILIES.items() for c in cs}
    out = [F.when(~(F.coalesce(F.array_contains("__bad", c), F.lit(False)) | F.coalesce(F.array_contains("__bad", family[c]), F.lit(False))), F.col(c)).alias(c) if c in family else F.when(~F.coalesce(F.array_contains("__bad", c), F.lit(False)), F.col(c)).alias(c) if c == "temp" else F.col(c) for c in data.columns]
    return met.select(*out)


def anomalies(data: DataFrame, channel: str, control: Anomaly | dict | None = None) -> DataFrame:
    """`data` with `anomaly` (true, false) and `checked` (the channel without anomalies).

    A reading is suspect if it changed faster than `max_rate` (and more than the resolution) against the reading
    before, or lies in a run of equal values above 0 of at least `stall_s` seconds. Suspects closer than the
    outlier window form groups: of a group of two the one of larger size falls, larger groups fall whole. Of
    what is left, runs of at most `isolated` readings between missing ones fall as well.
    """
    c = Anomaly.of(control)
    w = spec()
    x, t = F.col(channel), seconds()
    runs = with_runs(data.withColumn("__t", t), [channel], name="__run")
    per = Window.partitionBy("ID", "__run")
    stalled = (x > 0) & (F.max("__t").over(per) - F.min("__t").over(per) >= c.stall_s)
    xt = F.when(x.isNotNull(), F.struct(F.col("__t").alias("t"), x.alias("x")))
    before = F.last(xt, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    jump = F.abs(x - before["x"])
    fast = (jump > c.resolution) & (F.try_divide(jump, F.nullif(F.col("__t") - before["t"], F.lit(0.0))) > c.max_rate)
    df = runs.withColumn("__s", F.coalesce(fast | stalled, F.lit(False)))
    last = F.last(F.when(F.col("__s"), F.col("__t")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__g", F.sum((F.col("__s") & (F.col("__t") - last > c.outlier_window_s)).cast("int")).over(w))
    group = Window.partitionBy("ID", "__g", "__s")
    size, top = F.count(F.lit(1)).over(group), F.max(F.abs(x)).over(group)
    falls = F.col("__s") & ((size != 2) | (F.abs(x) == top))
    out = df.withColumn("anomaly", F.coalesce(falls, F.lit(False))).withColumn("checked", F.when(~F.col("anomaly"), x)).drop("__t", "__run", "__s", "__g")
    if c.isolated:
        out = isolated(out, "checked", c.isolated)
        out = out.withColumn("anomaly", F.col("anomaly") | F.col("island")).withColumn("checked", F.when(~F.col("island"), F.col("checked"))).drop("island")
    return out


def isolated(data: DataFrame, channel: str, most: int) -> DataFrame:
    """`data` with `island`: the reading lies in a run of at most `most` values between missing ones."""
    runs = with_runs(data.withColumn("__v", F.col(channel).isNotNull()), ["__v"], name="__run")
    size = F.count(F.lit(1)).over(Window.partitionBy("ID", "__run"))
    return runs.withColumn("island", F.col("__v") & (size <= most)).drop("__v", "__run")


def check_metadata(table: DataFrame, now: Column | None = None, tolerance_days: float = 1.0) -> DataFrame:
    """Issues ``id, check, severity`` of a deployments table: missing and repeated ids, missing and future
    deployment times, coordinates out of range, recovery before deployment, overlapping use of a package, and
    (info) reuse of a logger."""
    now = now if now is not None else F.current_timestamp()
    d = table.select(tidy(F.col("ID")).alias("id"), tidy(F.col("tag")).alias("tag"), tidy(F.col("pkg")).alias("pkg"), "dt", "rec", "lon", "lat")
    w = Window.partitionBy("pkg").orderBy("dt", "id")
    same, logger = Window.partitionBy("id"), Window.partitionBy("tag")
    d = d.withColumn("nxt", F.when(F.col("pkg").isNotNull() & F.col("dt").isNotNull(), F.lead("dt").over(w))).withColumn("many", F.count(F.lit(1)).over(same)).withColumn("uses", F.count(F.lit(1)).over(logger))
    bad = [
        ("missing_id", "error", F.col("id").isNull()), ("duplicate_id", "error", F.col("id").isNotNull() & (F.col("many") > 1)), ("missing_deploy", "error", F.col("dt").isNull()),
        ("future_deploy", "warning", F.unix_micros("dt") > F.unix_micros(now) + int(tolerance_days * 86_400_000_000)),
        ("coordinates", "error", (F.abs("lat") > 90) | (F.abs("lon") > 180)), ("recovery_before_deploy", "error", F.col("rec") < F.col("dt")),
        ("package_overlap", "error", F.col("nxt") < F.col("rec")), ("logger_reuse", "info", F.col("tag").isNotNull() & (F.col("uses") > 1)),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))) for check, severity, when in bad]))
    return d.select("id", F.explode(found).alias("x")).select("id", "x.check", "x.severity")


def metadata_status(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Per id ``failed``, ``passed_with_warnings`` or ``passed``."""
    worst = issues.groupBy("id").agg(F.max(rank(F.col("severity"))).alias("r"))
    return ids.select("id").distinct().join(worst, "id", "left").select("id", F.when(F.col("r") >= 3, "failed").when(F.col("r") == 2, "passed_with_warnings").otherwise("passed").alias("status"))


def excluded_sensors(table: DataFrame, column: str = "exclude") -> DataFrame:
    """Sensor tokens of a list column (``;`` or ``,``) as channels, with what names no sensor: ``ID, token, channel``."""
    from pelagia.functions.units import TOKENS
    from pelagia.operators.tag import CHANNELS

    pairs = [(t, c) for t, cs in TOKENS.items() for c in cs] + [(c, c) for c in CHANNELS]
    tokens = table.sparkSession.createDataFrame(pairs, "token string, channel string")
    each = table.select("ID", F.explode(F.split(F.lower(column), r"[;,\s]+")).alias("token")).where("token <> ''").distinct()
    return each.join(F.broadcast(tokens), "token", "left").select("ID", "token", "channel")  # a fixed table of names


def coregistration(data: DataFrame) -> DataFrame:
    """Per ID how well accelerometer and gyroscope agree: correlation of the turning of gravity with ``-w x g``
    where the animal turns faster than 0.15 rad/s."""
    w = spec()
    t = seconds()
    size = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    df = data.withColumn("__t", t)
    for a in "xyz":
        df = df.withColumn(f"__u{a}", F.try_divide(F.col(f"a{a}"), F.nullif(size, F.lit(0.0))))
    dt = F.lead("__t").over(w) - F.lag("__t").over(w)
    for a in "xyz":
        df = df.withColumn(f"__d{a}", F.try_divide(F.lead(f"__u{a}").over(w) - F.lag(f"__u{a}").over(w), F.nullif(dt, F.lit(0.0))))
    cross = {"x": F.col("gz") * F.col("__uy") - F.col("gy") * F.col("__uz"), "y": F.col("gx") * F.col("__uz") - F.col("gz") * F.col("__ux"), "z": F.col("gy") * F.col("__ux") - F.col("gx") * F.col("__uy")}
    rows = df.where(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2) > 0.15).select("ID", F.explode(F.array(*[F.struct(F.col(f"__d{a}").alias("d"), cross[a].alias("c")) for a in "xyz"])).alias("p")).select("ID", "p.*")
    return rows.groupBy("ID").agg(safe_corr(F.col("d"), F.col("c"), 200).alias("coreg_corr"), F.count("d").alias("n"))


def paddle_contamination(data: DataFrame, prominence: float = 30.0, least_hz: float = 3.5, harmonics: float = 6.0, top_share: float = 0.85, paddles: DataFrame | None = None) -> DataFrame:
    """Issues ``ID, check, channel, severity, value`` of a magnetometer with a narrow line that an undocumented paddle would make.

    Per axis the strongest peak over the median of the power spectrum, above `least_hz` and above `harmonics` times the tail
    beat (the strongest frequency from 0.1 to 2 Hz) and under `top_share` of Nyquist; the axis with the most prominent peak
    is reported if it is over `prominence`. IDs in `paddles` (``ID``) carry a paddle on purpose and are not looked at.
    """
    from pelagia.operators.process import power_spectra

    rows = data if paddles is None else data.join(paddles.select("ID").distinct(), "ID", "left_anti")
    spectra = power_spectra(rows, FAMILIES["mag"])
    beat = Window.partitionBy("ID", "channel")
    slow = F.when(F.col("freq").between(0.1, 2.0), F.struct("power", F.col("freq").alias("f")))
    marked = spectra.withColumn("floor", F.greatest(F.lit(least_hz), harmonics * F.coalesce(F.max(slow).over(beat)["f"], F.lit(0.0))))
    band = marked.where((F.col("freq") >= F.col("floor")) & (F.col("freq") <= top_share * F.col("hz") / 2))
    each = band.groupBy("ID", "channel").agg(F.count(F.lit(1)).alias("bins"), (F.max("power") / F.nullif(F.percentile("power", 0.5), F.lit(0.0))).alias("value")).where("bins >= 5 and value is not null")
    worst = each.groupBy("ID").agg(F.max_by(F.struct("channel", "value"), F.struct(F.col("value"), F.col("channel"))).alias("x")).select("ID", "x.*")
    return worst.where(F.col("value") > prominence).select("ID", F.lit("paddle_contamination").alias("check"), "channel", F.lit("warning").alias("severity"), F.round("value", 1).alias("value"))
