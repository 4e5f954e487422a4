"""Queries for the domain operators: quality, metadata, trimming, regularisation, dives, tracks, features,
tail beats, orientation, calibration, diel phase. Where SQL can say them, with SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.control import Dives
from pelagia.functions import solar
from pelagia.operators import alignment, dives, features, joins, magnetometer, mapping, process, quality, regularize, tailbeats, tracks, trim, unit_texts
from pelagia.operators import tag as tags
from pelagia.plans import domain_sql
from pelagia.plans.domain_sql import DIVE_METRICS, DIVE_TABLE, RATE_PHASES
from pelagia.plans.records import TAG, q, r6, record, rounded, with_heading
from pelagia.runtime import cut, shared_folder, table
from pelagia.sources.sinks import load_records, save_records

QUERIES: dict = {}
SQL: dict[str, str] = dict(domain_sql.SQL)


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def units_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean record in common units."""
    return tags.record(unit_texts.to_common_units(table(spark, sf_dir, "sensor_data"), table(spark, sf_dir, "sensor_files")))


# Quality and metadata


@query(f"""with {TAG}, m as (select "ID", {", ".join(f"count({c}) n_{c}, min({c}) min_{c}, max({c}) max_{c}" for c in ("ax", "gx", "mx"))}, {", ".join(f"case when count({b}) filter (ax is not null) >= 10 and stddev_samp(ax) filter ({b} is not null) >= 1e-9 and stddev_samp({b}) filter (ax is not null) >= 1e-9 then round(corr(ax, {b}), 4) + 0.0 end corr_{b}" for b in ("gx", "mx"))} from tag group by "ID"),
e as (select t."ID", {", ".join(f"greatest(count(*) filter (t.{c} = m.min_{c}), count(*) filter (t.{c} = m.max_{c})) ends_{c}" for c in ("ax", "gx", "mx"))} from tag t join m on t."ID" = m."ID" group by t."ID")
select m.*, {", ".join(f"e.ends_{c}" for c in ("ax", "gx", "mx"))} from m join e on m."ID" = e."ID" """)
def int1_metrics(spark, sf_dir):
    """What the integrity checks look at, for the x axes."""
    m = quality.integrity_metrics(record(spark, sf_dir))
    keep = [f"{k}_{c}" for c in ("ax", "gx", "mx") for k in ("n", "min", "max")]
    return m.select("ID", *keep, *[(F.round(f"corr_{c}", 4) + 0.0).alias(f"corr_{c}") for c in ("gx", "mx")], *[F.col(f"ends_{c}") for c in ("ax", "gx", "mx")])


@query()
def int1_integrity(spark, sf_dir):
    return quality.check_integrity(units_record(spark, sf_dir))


@query()
def flt6_drop_failed(spark, sf_dir):
    df = units_record(spark, sf_dir)
    return rounded(quality.drop_failed(df, quality.check_integrity(df)).select("record_id", "ax", "gx", "mx", "temp"))


@query(f"""with {TAG}, f as (select "ID", floor(us / 600000000)::bigint b, median(sqrt(mx*mx + my*my + mz*mz)) f from tag where mx is not null and my is not null and mz is not null group by all),
r as (select *, count(*) over (partition by "ID") n, rank() over (partition by "ID" order by f) + (count(*) over (partition by "ID", f) - 1) / 2 r from f),
s as (select *, count(*) over w n1, sum(r) over w r1, avg(f) over w m1, avg(f) over (partition by "ID" order by b rows between current row and unbounded following) m2 from r where n >= 30 window w as (partition by "ID" order by b rows between unbounded preceding and 1 preceding)),
a as (select *, greatest(u, 1 - u) auc from (select *, ((n * (n + 1) / 2 - r1) - (n - n1) * (n - n1 + 1) / 2) / (n1 * (n - n1)) u from s where n1 >= 5 and n - n1 >= 5)),
k as (select *, row_number() over (partition by "ID" order by auc desc, b) x from a)
select "ID", b * 600000000 at_us, {q('auc')} auc, {q('abs(m2 - m1) / greatest(abs(m1), 1e-9)')} step from k where x = 1 and auc > 0.96 and abs(m2 - m1) / greatest(abs(m1), 1e-9) >= 0.05""")
def int6_mag_breaks(spark, sf_dir):
    return rounded(quality.mag_breaks(record(spark, sf_dir)))


@query()
def sig8_coregistration(spark, sf_dir):
    return rounded(quality.coregistration(units_record(spark, sf_dir)))


@query()
def qlt2_anomalies(spark, sf_dir):
    return quality.anomalies(record(spark, sf_dir), "depth", {"max_rate": 5.0}).where("anomaly").select("record_id", "depth")


_META = """d as (select "ID" id, tag, pkg, dt, rec, lon, lat, lead(dt) over (partition by pkg order by dt, "ID") nx, count(*) over (partition by "ID") many, count(*) over (partition by tag) uses from deployments)"""


@query(f"""with {_META} select id, 'missing_id' "check", 'error' severity from d where id is null union all select id, 'duplicate_id', 'error' from d where many > 1 and id is not null union all select id, 'missing_deploy', 'error' from d where dt is null
union all select id, 'future_deploy', 'warning' from d where dt > timestamptz '2024-01-02 00:00:00+00' union all select id, 'coordinates', 'error' from d where abs(lat) > 90 or abs(lon) > 180 union all select id, 'recovery_before_deploy', 'error' from d where rec < dt
union all select id, 'package_overlap', 'error' from d where pkg is not null and dt is not null and nx < rec union all select id, 'logger_reuse', 'info' from d where tag is not null and uses > 1""")
def met1_issues(spark, sf_dir):
    """Checks of the deployments table, as of 1 January 2024."""
    return quality.check_metadata(table(spark, sf_dir, "deployments"), F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"""with {_META} select id, case when max(case when dt is null or (many > 1) or abs(lat) > 90 or abs(lon) > 180 or rec < dt or nx < rec then 1 else 0 end) = 1 then 'failed' when max(case when dt > timestamptz '2024-01-02 00:00:00+00' then 1 else 0 end) = 1 then 'passed_with_warnings' else 'passed' end status from d where id is not null group by id""")
def met1_status(spark, sf_dir):
    d = table(spark, sf_dir, "deployments")
    return quality.metadata_status(quality.check_metadata(d, F.lit("2024-01-01 00:00:00").cast("timestamp")), d.select(F.col("ID").alias("id")))


@query("""with t(token, channel) as (values ('accel','ax'),('accel','ay'),('accel','az'),('gyro','gx'),('gyro','gy'),('gyro','gz'),('mag','mx'),('mag','my'),('mag','mz'),('depth','depth'),('temp','temp')),
e as (select distinct "ID", unnest(string_split(case when cmd is null then 'accel;foo' else 'temp;depth' end, ';')) token from deployments) select e."ID", e.token, t.channel from e left join t on e.token = t.token""")
def met2_excluded(spark, sf_dir):
    d = table(spark, sf_dir, "deployments").select("ID", F.when(F.col("cmd").isNull(), "accel;foo").otherwise("temp;depth").alias("exclude"))
    return quality.excluded_sensors(d)


# Trimming and regularisation


@query()
def flt1_deployment_bounds(spark, sf_dir):
    return trim.deployment_bounds(record(spark, sf_dir), least_h=0.05)


@query()
def flt1_trimmed(spark, sf_dir):
    df = record(spark, sf_dir)
    return trim.trim(df, trim.deployment_bounds(df, least_h=0.05)).select("record_id", "ID")


@query(f"""with {TAG}, s as (select "ID", min(us) a, max(us) z from tag group by "ID") select s."ID", greatest(a, epoch_us(d.dt)) attach_us, least(z, coalesce(epoch_us(d.rec), z)) pop_us from s left join deployments d on s."ID" = d."ID" """)
def flt1_custom_bounds(spark, sf_dir):
    given = table(spark, sf_dir, "deployments").select("ID", F.col("dt").alias("attach"), F.col("rec").alias("pop"))
    return trim.custom_bounds(record(spark, sf_dir), given)


@query()
def reg1_regular(spark, sf_dir):
    return rounded(regularize.regularize(record(spark, sf_dir), ["depth", "temp"]))


@query()
def agg21_report(spark, sf_dir):
    df = record(spark, sf_dir)
    return rounded(regularize.report(df, regularize.regularize(df, ["depth", "temp"])))


@query()
def sup12_coverage(spark, sf_dir):
    return rounded(regularize.coverage(regularize.regularize(record(spark, sf_dir), ["depth", "temp"]), 100))


# Dives

_SURFACE = Dives(threshold=10.0, band=2.0, min_amplitude=5.0, min_duration_s=30.0, max_gap_s=600.0, wiggle=0.5, reference="surface", phase_method="prop_depth")


def _dives(spark: SparkSession, sf_dir: str, phases: str = "prop_depth") -> tuple[DataFrame, Dives]:
    return dives.detect(record(spark, sf_dir).where("depth is not null").select("record_id", "ID", "datetime", "depth", "temp"), replace(_SURFACE, phase_method=phases))


_DIVE = f"""{TAG}, d as (select record_id, "ID", us, t, depth, temp, depth >= 2 o, t - lag(t) over (partition by "ID" order by us) dt from tag where depth is not null),
r as (select *, sum(case when dt is null or dt > 600 or o <> po then 1 else 0 end) over (partition by "ID" order by us) run from (select *, lag(o) over (partition by "ID" order by us) po from d)),
k as (select "ID", run from r where o group by "ID", run having max(abs(depth)) > 10 and max(abs(depth)) - 2 >= 5 - 1e-9 and max(t) - min(t) >= 30),
n as (select r.*, k.run is not null dive, case when k.run is not null then dense_rank() over (partition by r."ID", k.run is not null order by r.run) else 0 end dive_id from r left join k on r."ID" = k."ID" and r.run = k.run),
p as (select *, max(abs(depth)) over (partition by "ID", dive_id) mx from n)"""


@query(f"""with {_DIVE}, f as (select *, min(case when abs(depth) >= 0.8 * mx then t end) over (partition by "ID", dive_id) a, max(case when abs(depth) >= 0.8 * mx then t end) over (partition by "ID", dive_id) z from p)
select record_id, dive_id, case when dive_id = 0 then 'inter_dive' when t < a then 'descent' when t > z then 'ascent' else 'bottom' end dive_phase from f""")
def div9_detect(spark, sf_dir):
    """Dives from the surface with fixed settings, and their phases."""
    df, _ = _dives(spark, sf_dir)
    return df.select("record_id", F.col("dive_id").cast("bigint").alias("dive_id"), "dive_phase")


@query(f"""with {_DIVE}, {RATE_PHASES} select record_id, dive_id, dive_phase from ph""")
def div9_phases(spark, sf_dir):
    """The same dives with phases by the vertical rate, the default."""
    df, _ = _dives(spark, sf_dir, "vertical_rate")
    return df.select("record_id", F.col("dive_id").cast("bigint").alias("dive_id"), "dive_phase")


@query(f"""with {_DIVE}, {RATE_PHASES}, {DIVE_TABLE}, {DIVE_METRICS}""")
def div10_metrics(spark, sf_dir):
    """All columns of the dive table, with phases by the vertical rate."""
    df, s = _dives(spark, sf_dir, "vertical_rate")
    return rounded(dives.metrics(df, s, ("temp",)))


@query()
def agg8_dive_table(spark, sf_dir):
    """All columns of the dive table, with settings and reference found from the cohort."""
    df, s = dives.detect(record(spark, sf_dir).select("ID", "datetime", "depth", "temp"), Dives())
    return dives.metrics(df, s, ("temp",))


@query(f"""with {_DIVE}, {DIVE_TABLE}
select "ID", count(*) n_dives, {q('median(duration_s) / 60')} duration_median_min, {q('max(duration_s) / 60')} duration_max_min, {q('median(max_depth)')} depth_median, {q('max(max_depth)')} depth_max_dive,
count(*) filter (not complete) n_incomplete, count(*) filter (ts or te) n_truncated, count(*) filter (edge > 0 or coalesce(behind > 600, false)) n_gapped from dt1 group by "ID" """)
def agg6_dives_per_deployment(spark, sf_dir):
    df, s = _dives(spark, sf_dir)
    return rounded(dives.per_deployment(dives.metrics(df, s)))


@query()
def agg15_dive_plot(spark, sf_dir):
    df, s = _dives(spark, sf_dir)
    return rounded(dives.plot_summary(dives.metrics(df, s), "max_depth"))


SQL["agg15_dive_plot"] = f"""with {_DIVE}, {DIVE_TABLE} select "ID", count(*) n_dives, count(*) filter (complete) n_used, count(*) filter (not complete) n_censored, 0::bigint n_unsupported, {q('median(max_depth) filter (complete)')} median,
{q('quantile_cont(max_depth, 0.25) filter (complete)')} q25, {q('quantile_cont(max_depth, 0.75) filter (complete)')} q75, {q('min(max_depth) filter (complete)')} "min", {q('max(max_depth) filter (complete)')} "max" from dt1 group by "ID" """


@query()
def flt9_usable_dives(spark, sf_dir):
    df, s = _dives(spark, sf_dir)
    return dives.metrics(df, s).select("ID", F.col("dive_id").cast("bigint").alias("dive_id"), dives.usable("inter_dive_s").alias("kind"))


SQL["flt9_usable_dives"] = f"""with {_DIVE}, {DIVE_TABLE} select "ID", dive_id, case when inter_dive_s is null then 'unsupported' when not inter_dive_censored then 'used' else 'censored' end kind from dt1"""


@query()
def div3_settings(spark, sf_dir):
    scanned = dives.scan(record(spark, sf_dir))
    s = dives.settings(scanned, Dives())
    return rounded(spark.createDataFrame([(s.threshold, s.band, s.min_amplitude, s.min_duration_s, s.max_gap_s, s.wiggle)], "threshold double, band double, min_amplitude double, min_duration_s double, max_gap_s double, wiggle double"))


_HEIGHTS = (5.0, 10.0, 20.0)


@query(f"""with {TAG}, d as (select "ID", depth, lag(depth) over (partition by "ID" order by us) p from tag where depth is not null) """ + " union all ".join(f"""select "ID", {h}::double threshold, count(*) filter (depth > {h} and (p <= {h} or p is null)) n_dives from d group by "ID" """ for h in _HEIGHTS))
def div13_sensitivity(spark, sf_dir):
    return dives.sensitivity(record(spark, sf_dir), list(_HEIGHTS))


@query(f"""with {_DIVE}, m as (select "ID", dive_id, max(t) - min(t) s from p where dive_id > 0 group by "ID", dive_id) select "ID", dive_id, {q('greatest(least(case when s >= 120 then 1 - 60 / s else s / 240 end, 1), 0)')} attenuation from m""")
def div12_attenuation(spark, sf_dir):
    df, s = _dives(spark, sf_dir)
    return dives.metrics(df, s).select("ID", "dive_id", r6(dives.attenuation(F.col("duration_s"), 60.0)).alias("attenuation"))


@query()
def int9_zero_offset(spark, sf_dir):
    df = record(spark, sf_dir).select("record_id", "ID", "datetime", "depth")
    from pelagia.sources.loggers import intervals_of, transitions

    dry = intervals_of(transitions(df.where("depth is not null").select("ID", "datetime", (F.col("depth") < 1).alias("dry")), "dry"), "dry").where("end is not null")
    return dives.zero_offset(df, dry).select("record_id", F.round("depth_corrected", 4).alias("depth_corrected"), "drift_status")


# Tracks


@query()
def flt4_screened_fixes(spark, sf_dir):
    return tracks.screen(table(spark, sf_dir, "positions"), table(spark, sf_dir, "deployments")).select("pos_id", "removed")


@query()
def flt4_plain_tests(spark, sf_dir):
    """The tests of satellites and of distance alone, without the speed test."""
    return tracks.screen(table(spark, sf_dir, "positions"), table(spark, sf_dir, "deployments"), {"max_iterations": 0}).select("pos_id", "removed")


@query()
def agg16_track_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "positions").where("datetime is not null and not isnan(lon)").groupBy("ID", "datetime").agg(F.min_by(F.struct("lon", "lat"), "pos_id").alias("x")).select("ID", "datetime", "x.lon", "x.lat")
    return rounded(tracks.track_metrics(p))


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, pitch and depth at 1 Hz, or at the record's own rate where that is lower."""
    from pelagia.operators.aggregates import time_bins

    df = with_heading(units_record(spark, sf_dir))
    return cut(time_bins(df, 1.0, ["depth", "pitch"], {"heading": 0.0}, keep_slower=True, times=table(spark, sf_dir, "sensor_data").select("ID", "datetime")))


@query()
def trk1_reconstruct(spark, sf_dir):
    out = tracks.reconstruct(_moving(spark, sf_dir), table(spark, sf_dir, "deployments"), table(spark, sf_dir, "positions").where("datetime is not null and type <> 'User'"))
    return rounded(out.select("ID", "datetime", "pseudo_lon", "pseudo_lat", "pseudo_error"))


@query()
def trk3_reckoned(spark, sf_dir):
    out = tracks.reckon(_moving(spark, sf_dir), table(spark, sf_dir, "deployments")).select("ID", "datetime", "speed_dr", "east_m", "north_m")
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("east_m", "north_m")}))


@query()
def trk9_directedness(spark, sf_dir):
    out = tracks.reconstructable(tracks.reckon(_moving(spark, sf_dir), table(spark, sf_dir, "deployments")))
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("path_m", "net_m")}))


@query()
def trk10_cross_validation(spark, sf_dir):
    out = tracks.cross_validate(_moving(spark, sf_dir), table(spark, sf_dir, "deployments"), table(spark, sf_dir, "positions").where("datetime is not null and type <> 'User'"))
    return rounded(out.withColumn("error_m", F.round("error_m", 1)))


@query(f"""with {TAG}, b as (select *, row_number() over (partition by "ID", floor(us / 300000000) order by us) n from tag where pseudo_lon is not null and pseudo_lat is not null)
select "ID" id, us date, case when depth is not null then 'GL' else 'G' end lc, pseudo_lon lon, pseudo_lat lat, depth x_sd, depth y_sd from b where n = 1""")
def snk3_export_ssm(spark, sf_dir):
    """Thinned track for state-space models (here with depth in the place of the error)."""
    return rounded(tracks.export_for_ssm(record(spark, sf_dir), 5, error="depth"))


@query()
def snk1_saved_and_read(spark, sf_dir):
    """Records written by ID and read back."""
    import uuid

    path = save_records(record(spark, sf_dir).select("record_id", "ID", "datetime", "depth"), f"{shared_folder(spark)}/records-{uuid.uuid4().hex}", "snappy", salt=4)
    return rounded(load_records(spark, path).select("record_id", "ID", "datetime", "depth"))


SQL["snk1_saved_and_read"] = f'with {TAG} select record_id, "ID", us datetime, {q("depth")} depth from tag'


# Features and behaviour

_GRID = [("depth", "mean", 5.0), ("depth", "sd", 5.0), ("depth", "median", 5.0), ("depth", "energy", 5.0), ("depth", "rate", 5.0), ("heading", "mrl", 5.0)]


@query(f"""with {TAG}, p as (select *, degrees(atan2(-ax, sqrt(ay*ay + az*az))) pitch, degrees(atan2(ay, az)) roll from tag), h0 as (select *, mx * cos(radians(pitch)) + my * sin(radians(pitch)) * sin(radians(roll)) + mz * sin(radians(pitch)) * cos(radians(roll)) xh, my * cos(radians(roll)) - mz * sin(radians(roll)) yh from p),
h as (select "ID", us, depth, case when abs(pitch) <= 89.5 then ((degrees(atan2(-yh, xh)) + 5.0) % 360 + 360) % 360 end heading from h0), d as (select *, abs(depth - lag(depth) over (partition by "ID" order by us)) dd from h where depth is not null and heading is not null),
f as (select "ID", us, count(*) over c n, avg(depth) over c mean, stddev_samp(depth) over c sd, median(depth) over c med, sum(depth * depth) over c en, avg(dd) over i rt, sqrt(pow(avg(sin(radians(heading))) over c, 2) + pow(avg(cos(radians(heading))) over c, 2)) mrl from d window c as (partition by "ID" order by us rows between 2 preceding and 2 following), i as (partition by "ID" order by us rows between 1 preceding and 2 following))
select "ID", us datetime, {q('mean')} depth_mean_5s, round(sd, 4) + 0.0 depth_sd_5s, {q('med')} depth_median_5s, round(en, 4) + 0.0 depth_energy_5s, {q('rt')} depth_rate_5s, {q('mrl')} heading_mrl_5s from f where n = 5""")
def fea1_features(spark, sf_dir):
    df = with_heading(record(spark, sf_dir)).where("depth is not null and heading is not null")
    out = features.features(df, _GRID)
    return out.select("ID", F.unix_micros("datetime").alias("datetime"), *[(F.round(c, 4) + 0.0 if c in ("depth_sd_5s", "depth_energy_5s") else r6(F.col(c))).alias(c) for c in out.columns if c not in ("ID", "datetime")])


@query(f"""with {TAG}, d as (select "ID", us, depth, floor((row_number() over (partition by "ID" order by us) - 1) / 60) n from tag where depth is not null)
select "ID", min(us) datetime, {q('avg(depth)')} depth_mean_60s, round(stddev_samp(depth), 4) + 0.0 depth_sd_60s, {q('quantile_cont(depth, 0.75) - quantile_cont(depth, 0.25)')} depth_iqr_60s from d group by "ID", n""")
def fea2_tumbling(spark, sf_dir):
    out = features.features(record(spark, sf_dir).where("depth is not null"), [("depth", m, 60.0) for m in ("mean", "sd", "iqr")], aggregate=True)
    return out.select("ID", F.unix_micros("datetime").alias("datetime"), r6(F.col("depth_mean_60s")).alias("depth_mean_60s"), (F.round("depth_sd_60s", 4) + 0.0).alias("depth_sd_60s"), r6(F.col("depth_iqr_60s")).alias("depth_iqr_60s"))


@query()
def fea3_circular(spark, sf_dir):
    df = with_heading(record(spark, sf_dir)).where("heading is not null")
    return features.features(df, [("heading", m, 5.0) for m in ("mean", "median", "sd", "range", "iqr")]).select("ID", F.unix_micros("datetime").alias("datetime"), *[(F.round(f"heading_{m}_5s", 4) + 0.0).alias(m) for m in ("mean", "median", "sd", "range", "iqr")])


@query()
def fea4_enhanced(spark, sf_dir):
    return rounded(features.enhanced(with_heading(record(spark, sf_dir)).where("depth is not null and heading is not null")))


@query()
def fea8_rhythms(spark, sf_dir):
    return rounded(features.rhythms(with_heading(record(spark, sf_dir)).where("depth is not null and heading is not null"), 20))


@query()
def fea5_stability(spark, sf_dir):
    return rounded(features.stability(with_heading(record(spark, sf_dir))))


@query()
def fea6_distribution_shape(spark, sf_dir):
    out = features.features(record(spark, sf_dir).where("temp is not null"), [("temp", m, 10.0) for m in ("mad", "entropy", "skewness", "kurtosis", "range")])
    return out.select("ID", F.unix_micros("datetime").alias("datetime"), *[(F.round(F.col(c) + (3e-8 if c == "temp_kurtosis_10s" else 0.0), 6) + 0.0).alias(c) for c in out.columns if c not in ("ID", "datetime")])


@query(f"""with {TAG}, f as (select "ID", us, case when depth > 20 then 1 else 0 end y from tag where depth is not null), o as (select "ID", min(us) u from f group by "ID")
select f."ID", floor((f.us / 1e6 - o.u / 1e6) / 60)::bigint "window", case when avg(y) > 0.5 then 1 else 0 end response from f join o on f."ID" = o."ID" group by all""")
def fea7_labels(spark, sf_dir):
    rows = record(spark, sf_dir).where("depth is not null").select("ID", "datetime", (F.col("depth") > 20).cast("int").alias("y"))
    return rounded(features.label_windows(rows, "y", 60))


@query()
def srt4_top_segments(spark, sf_dir):
    df = with_heading(record(spark, sf_dir)).where("depth is not null")
    return rounded(features.top_segments(df, "depth", 5, 20.0))


@query()
def tbf_tail_beats(spark, sf_dir):
    return tailbeats.tail_beats(units_record(spark, sf_dir).withColumn("sway", F.col("ay")), control={"max_hz": 0.2, "min_hz": 0.02, "window_s": 120.0})


@query()
def tbf_best_axis(spark, sf_dir):
    df = units_record(spark, sf_dir).select("ID", "datetime", F.col("ax").alias("surge"), F.col("ay").alias("sway"), F.col("az").alias("heave"))
    return tailbeats.best_axis(df, low=0.01, high=0.2)


# Processing, orientation, calibration


@query()
def k0_pivot(spark, sf_dir):
    return process.pivot(units_record(spark, sf_dir), declination=5.0, smoothing={"static_s": 60.0}, downsample_hz=1.0)


@query()
def k10_attitude(spark, sf_dir):
    return process.attitude(units_record(spark, sf_dir).select("ID", "datetime", "ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")).select("ID", "datetime", F.round("pitch", 3).alias("pitch"), F.round("roll", 3).alias("roll"), F.round("heading", 3).alias("heading"))


@query()
def k12_mount_offsets(spark, sf_dir):
    return rounded(process.mount_offsets(process.vertical_velocity(with_heading(units_record(spark, sf_dir)))))


@query()
def k6_burst(spark, sf_dir):
    df = units_record(spark, sf_dir).withColumn("vedba", F.abs(process.magnitude() - 1))
    return process.with_burst(df, process.burst_limits(df)).select("record_id", "burst")


@query()
def k7_jerk(spark, sf_dir):
    return process.with_jerk(units_record(spark, sf_dir)).select("record_id", (F.round("jerk", 4) + 0.0).alias("jerk"))


@query()
def k9_vertical_velocity(spark, sf_dir):
    return rounded(process.vertical_velocity(with_heading(units_record(spark, sf_dir))).select("record_id", "vertical_velocity"))


@query()
def k13_offsets_taken_off(spark, sf_dir):
    offsets = table(spark, sf_dir, "deployments").where("ID like 'C%'").select("ID", F.lit(4.5).alias("pitch_offset"), F.lit(170.0).alias("roll_offset"))
    return rounded(process.without_offsets(with_heading(units_record(spark, sf_dir)), offsets).select("record_id", "pitch", "roll"))


@query()
def k14_smoothed_orientation(spark, sf_dir):
    return rounded(process.smooth_orientation(with_heading(units_record(spark, sf_dir)), 60.0).select("record_id", "roll", "heading", "pitch"))


@query()
def flt11_anomalous_mounting(spark, sf_dir):
    return rounded(process.anomalous_mounting(with_heading(units_record(spark, sf_dir))))


@query()
def int8_paddle_contamination(spark, sf_dir):
    return quality.paddle_contamination(units_record(spark, sf_dir))


@query()
def k2_paddle_state(spark, sf_dir):
    return process.paddle_state(units_record(spark, sf_dir), least_hz=0.01)


@query()
def k18_paddle(spark, sf_dir):
    return process.paddle_frequency(units_record(spark, sf_dir), 60.0, 30.0, (0.01, 0.2))


@query()
def ori1_scores(spark, sf_dir):
    return mapping.scores(units_record(spark, sf_dir))


@query()
def ori1_proposals(spark, sf_dir):
    return mapping.propose(mapping.scores(units_record(spark, sf_dir)))


@query()
def ori2_review_queue(spark, sf_dir):
    return mapping.review_queue(mapping.propose(mapping.scores(units_record(spark, sf_dir))))


@query()
def flt13_static(spark, sf_dir):
    return mapping.static_rows(units_record(spark, sf_dir)).where("stable").select("record_id")


@query(f"""with {TAG}, o as (select * from tag where mx is not null and my is not null and mz is not null), c as (select "ID", count(*) n, (quantile_cont(mx, 0.02) + quantile_cont(mx, 0.98)) / 2 cx, (quantile_cont(my, 0.02) + quantile_cont(my, 0.98)) / 2 cy, (quantile_cont(mz, 0.02) + quantile_cont(mz, 0.98)) / 2 cz from o group by "ID"),
r as (select o."ID", median(sqrt((mx - cx)**2 + (my - cy)**2 + (mz - cz)**2)) radius from o join c on o."ID" = c."ID" group by o."ID")
select c."ID", n, case when n >= 100 then round(cx, 4) + 0.0 end cx, case when n >= 100 then round(cy, 4) + 0.0 end cy, case when n >= 100 then round(cz, 4) + 0.0 end cz, case when n >= 100 then round(radius, 4) + 0.0 end radius from c join r on c."ID" = r."ID" """)
def agg20_hard_iron(spark, sf_dir):
    return magnetometer.hard_iron(record(spark, sf_dir)).select("ID", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy", "cz", "radius")])


@query()
def mag2_ellipsoids(spark, sf_dir):
    return magnetometer.ellipsoids(units_record(spark, sf_dir))


@query()
def mag4_coverage(spark, sf_dir):
    df = units_record(spark, sf_dir)
    return rounded(magnetometer.coverage(df, magnetometer.hard_iron(df).where("cx is not null")))


@query()
def prj9_calibrated(spark, sf_dir):
    df = units_record(spark, sf_dir)
    # Hard iron alone: centres, and no turning or stretching of the axes.
    fits = magnetometer.hard_iron(df).where("cx is not null").select("ID", "cx", "cy", "cz", *[F.lit(float(i == j)).alias(f"s{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)])
    return rounded(magnetometer.spread_of_radius(process.apply_mag_calibration(df, fits)))


@query()
def aln1_clock_offsets(spark, sf_dir):
    """The record's own depth, 40 s late, as the archive."""
    df = record(spark, sf_dir).select("ID", "datetime", "depth")
    late = df.withColumn("datetime", F.timestamp_micros(F.unix_micros("datetime") + 40_000_000))
    return alignment.clock_offsets(df, late, {"max_lag_s": 120})


@query()
def fun_diel_phase(spark, sf_dir):
    p = table(spark, sf_dir, "positions").select("pos_id", "datetime", "lon", "lat")
    for n in (2, 3, 4):
        p = solar.with_diel_phase(p, f"phase{n}", n)
    return p.select("pos_id", "phase2", "phase3", "phase4")


@query()
def trk8_speed_calibration(spark, sf_dir):
    track = tracks.reckon(_moving(spark, sf_dir), table(spark, sf_dir, "deployments")).withColumn("vedba", F.abs("pitch"))
    return tracks.speed_calibration(track, tracks.anchors(track, table(spark, sf_dir, "positions").where("datetime is not null and type <> 'User'")))


@query("""select "ID", case when h.trust is null then 'unknown' else h.trust end trust from (select "ID", case when cmd is null then 'raw' when cmd = 'CMD' then 'applied' else cmd end status from deployments) d left join (values ('raw', 'untrusted'), ('applied', 'trusted')) h(status, trust) on d.status = h.status""")
def sup2_heading_trust(spark, sf_dir):
    d = table(spark, sf_dir, "deployments")
    status = F.when(F.col("cmd").isNull(), "raw").when(F.col("cmd") == "CMD", "applied").otherwise(F.col("cmd"))
    return d.select("ID", tags.heading_trust(status).alias("trust"))


@query("""select "ID", case when pkg is not null and cmd is not null then pkg || '|' || cmd end key from deployments""")
def sup4_group_key(spark, sf_dir):
    return table(spark, sf_dir, "deployments").select("ID", tags.group_key(["pkg", "cmd"]).alias("key"))


@query(f"""with {TAG} select t.record_id from tag t where not exists (select 1 from deployments d where d."ID" = t."ID" and d.cmd is null)""")
def flt12_excluded(spark, sf_dir):
    decisions = table(spark, sf_dir, "deployments").select("ID", F.when(F.col("cmd").isNull(), "exclude").otherwise("keep").alias("decision"))
    return mapping.decided(record(spark, sf_dir), decisions).select("record_id")


@query()
def his1_history(spark, sf_dir):
    """A history of two steps for every deployment, flattened."""
    ids = table(spark, sf_dir, "deployments").select("ID")
    h = tags.append_history(tags.empty_history(spark), ids, "trim", {"depth_limit": 3.5})
    h = tags.append_history(h, ids, "pivot", {"hz": 1, "static_s": 3.0})
    return tags.flatten_history(h).select("ID", "seq", "step", "key", "value")


SQL["his1_history"] = """select distinct "ID", seq::bigint seq, step, key, value from deployments, (values (1, 'trim', 'depth_limit', '3.5'), (2, 'pivot', 'hz', '1'), (2, 'pivot', 'static_s', '3.0')) v(seq, step, key, value)"""


@query()
def join7_interval_carry(spark, sf_dir):
    """Readings with the annotation that covers them."""
    return joins.in_intervals(record(spark, sf_dir).select("record_id", "ID", "datetime"), table(spark, sf_dir, "annotations"), ["ID"], "start", "end", carry=["ann_id"]).select("record_id", "ann_id")


SQL["join7_interval_carry"] = f"""with {TAG} select t.record_id, a.ann_id from tag t join annotations a on t."ID" = a."ID" and t.datetime between a."start" and a."end" """
