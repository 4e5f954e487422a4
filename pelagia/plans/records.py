"""Queries for the operators on records: projections, joins, aggregations, windows; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.functions import angles, geo, units
from pelagia.operators import aggregates, joins, process, regularize, tag, windows
from pelagia.operators.tag import seconds
from pelagia.runtime import table
from pelagia.sources import loggers

QUERIES: dict = {}
SQL: dict[str, str] = {}

CHANNELS = ["ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz", "depth", "temp", "pseudo_lon", "pseudo_lat"]
#: The clean record in SQL.
TAG = "tag as (select * from (select record_id, \"ID\", file_no, datetime, epoch_us(datetime) us, epoch_us(datetime) / 1e6 t, " + ", ".join(f"case when not isnan({c}) then {c} end {c}" for c in CHANNELS) + ', row_number() over (partition by "ID", datetime order by record_id) rn from sensor_data) where rn = 1)'


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def r6(x: Column) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag.record(table(spark, sf_dir, "sensor_data"))


def q(x: str) -> str:
    return f"round({x}, 6) + 0.0"


@query(f"with {TAG} select record_id, \"ID\", us from tag")
def d1_record(spark, sf_dir):
    """The clean fleet record: one row per ID and time."""
    return record(spark, sf_dir).select("record_id", "ID", F.unix_micros("datetime").alias("us"))


@query(f"""with {TAG} select t."ID", min(us) first_datetime, max(us) last_datetime, count(*) n_rows,
concat_ws('+', {", ".join(f"case when count({c}) > 0 then '{c}' end" for c in CHANNELS[:11])}) sensors, any_value(d.species) species
from tag t left join deployments d on t."ID" = d."ID" group by t."ID" """)
def sup1_metadata(spark, sf_dir):
    m = tag.metadata(record(spark, sf_dir), table(spark, sf_dir, "deployments").select("ID", "species"))
    return rounded(m)


@query(f"""with {TAG}, d as (select "ID", us, t - lag(t) over (partition by "ID" order by us) dt from tag)
select "ID", round(count(*) / count(distinct floor(us / 1000000))) per_second, {q('1 / median(case when dt > 0 then dt end)')} hz from d group by "ID" """)
def src16_sampling_rate(spark, sf_dir):
    return rounded(tag.sampling_rate(record(spark, sf_dir)))


@query("""select "ID", epoch_us(datetime) us, pos_id, type from (select *, row_number() over (partition by "ID", datetime order by pos_id) n from positions
where datetime is not null and type <> 'User') where n = 1""")
def src8_positions(spark, sf_dir):
    """Satellite fixes: with a time, one per time, without fixes of type User."""
    p = table(spark, sf_dir, "positions").where("datetime is not null and type <> 'User'")
    first = p.groupBy("ID", "datetime").agg(F.min_by(F.struct("pos_id", "type"), "pos_id").alias("x"))
    return first.select("ID", F.unix_micros("datetime").alias("us"), "x.pos_id", "x.type")


@query(f"""with {TAG}, s as (select "ID", us, depth < 1 dry from tag where depth is not null),
l as (select *, lag(dry) over (partition by "ID" order by us) p from s) select "ID", us, dry from l where p is null or p <> dry""")
def src9_dry_transitions(spark, sf_dir):
    rows = record(spark, sf_dir).where("depth is not null").select("ID", "datetime", (F.col("depth") < 1).alias("dry"))
    return rounded(loggers.transitions(rows, "dry")).withColumnRenamed("datetime", "us")


@query(f"""with {TAG}, s as (select "ID", us, depth < 1 dry from tag where depth is not null),
l as (select *, lag(dry) over (partition by "ID" order by us) p from s), c as (select *, lead(us) over (partition by "ID" order by us) nx from l where p is null or p <> dry)
select "ID", us "start", nx "end" from c where dry""")
def d7_dry_intervals(spark, sf_dir):
    rows = record(spark, sf_dir).where("depth is not null").select("ID", "datetime", (F.col("depth") < 1).alias("dry"))
    return rounded(loggers.intervals_of(loggers.transitions(rows, "dry"), "dry"))


@query(f"""with {TAG} select record_id, {q('temp * 9 / 5 + 32')} temp_f, {q('temp + 273.15')} temp_k, {q('depth / 0.9945')} depth_dbar, {q('depth / 0.3048')} depth_ft from tag""")
def prj1_units(spark, sf_dir):
    c = units.convert
    return record(spark, sf_dir).select("record_id", r6(c(F.col("temp"), "C", "F")).alias("temp_f"), r6(c(F.col("temp"), "C", "K")).alias("temp_k"), r6(c(F.col("depth"), "m", "dbar")).alias("depth_dbar"), r6(c(F.col("depth"), "m", "ft")).alias("depth_ft"))


@query(f"with {TAG} select record_id, {q('sqrt(ax*ax + ay*ay + az*az)')} accel from tag")
def prj5_magnitude(spark, sf_dir):
    return record(spark, sf_dir).select("record_id", r6(process.magnitude()).alias("accel"))


_TILT = "p as (select *, degrees(atan2(-ax, sqrt(ay*ay + az*az))) pitch, degrees(atan2(ay, az)) roll from tag)"


@query(f"""with {TAG}, {_TILT} select record_id, {q('pitch')} pitch, {q('roll')} roll, {q('((((roll - 30 + 180) % 360) + 360) % 360) - 180')} roll_mounted from p""")
def prj10_tilt(spark, sf_dir):
    pitch, roll = process.tilt(F.col("ax"), F.col("ay"), F.col("az"))
    return record(spark, sf_dir).select("record_id", r6(pitch).alias("pitch"), r6(roll).alias("roll"), r6(angles.wrap180(roll - 30)).alias("roll_mounted"))


_HEAD = """h as (select *, mx * cos(radians(pitch)) + my * sin(radians(pitch)) * sin(radians(roll)) + mz * sin(radians(pitch)) * cos(radians(roll)) xh,
my * cos(radians(roll)) - mz * sin(radians(roll)) yh from p), hd as (select *, case when abs(pitch) <= 89.5 then ((degrees(atan2(-yh, xh)) + 5.0) % 360 + 360) % 360 end heading from h)"""


@query(f"with {TAG}, {_TILT}, {_HEAD} select record_id, {q('heading')} heading from hd")
def prj11_heading(spark, sf_dir):
    df = with_heading(record(spark, sf_dir))
    return df.select("record_id", r6(F.col("heading")).alias("heading"))


def with_heading(df: DataFrame) -> DataFrame:
    pitch, roll = process.tilt(F.col("ax"), F.col("ay"), F.col("az"))
    df = df.withColumn("pitch", pitch).withColumn("roll", roll)
    return df.withColumn("heading", process.heading(F.col("pitch"), F.col("roll"), F.col("mx"), F.col("my"), F.col("mz"), 5.0))


@query(f"with {TAG} select record_id, greatest(depth, 0) depth from tag where depth is not null and pseudo_lon is not null")
def prj15_clamp_finite(spark, sf_dir):
    """Depth not under 0, of rows whose depth and longitude are finite."""
    return record(spark, sf_dir).where("depth is not null and pseudo_lon is not null").select("record_id", F.greatest("depth", F.lit(0.0)).alias("depth"))


@query(f"""with {TAG} select t.record_id, -ay ax, ax ay, az from tag t join deployments d on t."ID" = d."ID" where d.pkg like '%A%'
union all select t.record_id, ax, ay, az from tag t left join deployments d on t."ID" = d."ID" where d.pkg is null or d.pkg not like '%A%'""")
def prj6_axis_mapping(spark, sf_dir):
    """Axes of packages of series A turned by a quarter about the vertical; others stay."""
    nets = table(spark, sf_dir, "deployments").where("pkg like '%A%'").select("ID", F.lit("accel").alias("family"), F.array(*[F.lit(x) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)]).alias("m"))
    out = process.apply_axis_mapping(record(spark, sf_dir), nets)
    return out.select("record_id", *[(F.col(c) + 0.0).alias(c) for c in ("ax", "ay", "az")])


SQL["prj6_axis_mapping"] = f"""with {TAG}, d as (select distinct "ID" from deployments where pkg like '%A%')
select t.record_id, case when d."ID" is null then ax else -ay end + 0.0 ax, case when d."ID" is null then ay else ax end + 0.0 ay, az + 0.0 az from tag t left join d on t."ID" = d."ID" """


# Joins


@query(f"""with {TAG}, s as (select "ID", us, us - lag(us) over (partition by "ID" order by us) dt from tag),
g0 as (select "ID", min(us) a, max(us) z, round(median(case when dt > 0 then dt end))::bigint step from s group by "ID"),
g as (select "ID", step, unnest(range(a, z + 1, step)) us from g0 where step > 0),
b as (select g."ID", g.us, g.step, t.us bu, t.depth bd, t.temp bt from g asof left join tag t on g."ID" = t."ID" and g.us >= t.us),
n as (select b.*, t.us nu, t.depth nd, t.temp nt from b asof left join tag t on b."ID" = t."ID" and b.us <= t.us),
c as (select "ID", us, step, case when nu is null or us - bu <= nu - us then bu else nu end nearest, case when nu is null or us - bu <= nu - us then bd else nd end d, case when nu is null or us - bu <= nu - us then bt else nt end tp from n)
select "ID", us, round(case when abs(nearest - us) <= 0.5 * step then d end, 6) + 0.0 depth, round(case when abs(nearest - us) <= 0.5 * step then tp end, 6) + 0.0 "temp" from c""")
def join1_nearest_grid(spark, sf_dir):
    """Readings on each record's regular grid, the nearest within half a step."""
    df = record(spark, sf_dir)
    met = joins.as_of(regularize.grid(df), df.select("ID", "datetime", F.col("datetime").alias("at"), "depth", "temp"), ["at", "depth", "temp"])
    near = F.abs(F.unix_micros("at") - F.unix_micros("datetime")) <= 0.5 * F.col("step_us")
    return met.select("ID", F.unix_micros("datetime").alias("us"), r6(F.when(near, F.col("depth"))).alias("depth"), r6(F.when(near, F.col("temp"))).alias("temp"))


@query(f"""with {TAG}, v as (select seg_id, "ID", epoch_us("start") us from video_segments where "start" is not null)
select seg_id, t.record_id from v asof left join tag t on v."ID" = t."ID" and v.us >= t.us""")
def join5_backward_asof(spark, sf_dir):
    """The last reading not after each video's first frame."""
    v = table(spark, sf_dir, "video_segments").where("start is not null").select("seg_id", "ID", F.col("start").alias("datetime"))
    return joins.as_of(v, record(spark, sf_dir).select("ID", "datetime", "record_id"), ["record_id"], "backward").select("seg_id", "record_id")


@query(f"""with {TAG}, sp as (select "ID", min(us) a, max(us) z from tag group by "ID"), p as (select pos_id, p."ID", epoch_us(datetime) us from positions p join sp on p."ID" = sp."ID" where epoch_us(datetime) between a and z),
b as (select p.*, t.us bu from p asof left join tag t on p."ID" = t."ID" and p.us >= t.us), n as (select b.*, t.us nu from b asof left join tag t on b."ID" = t."ID" and b.us <= t.us),
c as (select pos_id, "ID", us, case when us - bu <= nu - us then bu else nu end nearest from n)
select "ID", nearest us, arg_max(pos_id, us * 1000000000::hugeint + pos_id) pos_id from c group by "ID", nearest""")
def join6_snap(spark, sf_dir):
    """Fixes on the nearest reading; the latest of several on one."""
    out = joins.snap_to_rows(table(spark, sf_dir, "positions").where("datetime is not null"), record(spark, sf_dir))
    return out.select("ID", F.unix_micros("datetime").alias("us"), "pos_id")


_EVENTS = ["feeding", "breach", "resting", "social"]


@query(f"""with {TAG}, a as (select "ID", event, epoch_us("start") s, epoch_us("end") e from annotations where "end" >= "start")
select t.record_id, {", ".join(f"max(case when a.event = '{e}' then 1 else 0 end) {e}" for e in _EVENTS)} from tag t left join a on t."ID" = a."ID" and t.us between a.s and a.e group by t.record_id""")
def join7_event_flags(spark, sf_dir):
    """0/1 per event for each reading."""
    out = joins.flag_intervals(record(spark, sf_dir).select("record_id", "ID", "datetime"), table(spark, sf_dir, "annotations"), _EVENTS)
    return out.select("record_id", *[F.col(e).cast("bigint").alias(e) for e in _EVENTS])


@query(f"""with {TAG} select record_id from tag t where exists (select 1 from video_segments v where v."ID" = t."ID" and t.datetime between v."start" and v."end")""")
def flt3_video_period(spark, sf_dir):
    return joins.keep_in_intervals(record(spark, sf_dir).select("record_id", "ID", "datetime"), table(spark, sf_dir, "video_segments")).select("record_id")


@query("""with p as (select pos_id, "ID", floor(epoch_us(datetime) / 1000000) s from positions where datetime is not null),
v as (select "ID", video, floor(epoch_us("start") / 1000000) a, floor(epoch_us("end") / 1000000) z from video_segments),
m as (select pos_id, video, row_number() over (partition by pos_id order by a, video) n from p join v on p."ID" = v."ID" and p.s between v.a and v.z) select pos_id, video from m where n = 1""")
def join8_clip_at(spark, sf_dir):
    """The video clip that shows each fix's second."""
    return joins.first_interval(table(spark, sf_dir, "positions").where("datetime is not null"), table(spark, sf_dir, "video_segments"), "video", "pos_id")


@query("""with d as (select "ID", pkg, rec, lead(dt) over (partition by pkg order by dt, "ID") nx, lead("ID") over (partition by pkg order by dt, "ID") next_id from deployments where pkg is not null and dt is not null)
select "ID", next_id from d where nx < rec""")
def join13_package_overlap(spark, sf_dir):
    return joins.overlapping_next(table(spark, sf_dir, "deployments"), "pkg", "dt", "rec", "ID")


@query(f"""with {TAG}, c as (select "ID", string_agg(firmware, '/' order by firmware) firmware from (select distinct "ID", firmware from sensor_files where firmware is not null) group by "ID")
select s."ID", s.n, coalesce(c.firmware, '') firmware from (select "ID", count(*) n from tag group by "ID") s left join c on s."ID" = c."ID" """)
def join4_covariates(spark, sf_dir):
    n = record(spark, sf_dir).groupBy("ID").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.with_covariates(n, table(spark, sf_dir, "sensor_files"), ["firmware"]).withColumn("firmware", F.coalesce("firmware", F.lit("")))


@query("""with s as (select "ID", count(*) n from positions group by "ID"), r as (select "ID" from deployments)
select r."ID", s.n, case when s."ID" is null then 'excluded' else 'included' end status from r left join s on r."ID" = s."ID" """)
def join10_roster(spark, sf_dir):
    n = table(spark, sf_dir, "positions").groupBy("ID").agg(F.count(F.lit(1)).alias("n"))
    roster = table(spark, sf_dir, "deployments").select("ID", F.col("dt").alias("position"))
    return tag.complete_roster(n, roster)


@query("""select a.ann_id, case when d."ID" is null then 'orphan' else 'known' end kind from annotations a left join (select distinct "ID" from deployments where cmd is not null) d on a."ID" = d."ID" """)
def join12_orphans(spark, sf_dir):
    """Annotations with and without a commanded deployment, by semi and anti joins."""
    a, d = table(spark, sf_dir, "annotations").select("ann_id", "ID"), table(spark, sf_dir, "deployments").where("cmd is not null").select("ID")
    return a.join(d, "ID", "left_semi").select("ann_id", F.lit("known").alias("kind")).unionByName(a.join(d, "ID", "left_anti").select("ann_id", F.lit("orphan").alias("kind")))


@query("""with f as (select "ID", max(firmware) firmware from sensor_files group by "ID") select d."ID", coalesce(f.firmware, d.cmd) cmd from deployments d left join f on d."ID" = f."ID" """)
def join15_update(spark, sf_dir):
    new = table(spark, sf_dir, "sensor_files").select("ID", F.col("firmware").alias("cmd"))
    return tag.update_biometrics(table(spark, sf_dir, "deployments").select("ID", "cmd"), new, ["cmd"])[0]


@query("""with b as (select "ID", min(firmware) v from sensor_files where "ID" is not null group by "ID"), c as (select d.pkg, min(f.firmware) v from sensor_files f join deployments d on f."ID" = d."ID" where d.pkg is not null group by d.pkg)
select d."ID", coalesce(b.v, c.v) firmware from deployments d left join b on d."ID" = b."ID" left join c on d.pkg = c.pkg""")
def join11_prioritised(spark, sf_dir):
    d = table(spark, sf_dir, "deployments").select("ID", "pkg")
    right = table(spark, sf_dir, "sensor_files").select("ID", "firmware").join(d, "ID", "left")
    one = joins.prioritised(d.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)), ["ID", "pkg"], "firmware", ["k"])
    return one.select("ID", "firmware")


# Aggregations


@query(f"""with {TAG}, {_TILT}, {_HEAD}, o as (select *, min(us) over (partition by "ID") u0 from hd), b as (select "ID", u0, floor((us - u0) * 0.1 / 1e6)::bigint b, depth, temp, heading, depth > 20 deep from o)
select "ID", u0 + b * 10000000 us, {q('avg(depth)')} depth, {q('avg(temp)')} "temp",
case when avg(cos(radians(heading))) is null then null else round(((degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) % 360) + 360) % 360, 4) + 0.0 end heading, max(case when deep then 1 when not deep then 0 end) deep from b group by "ID", u0, b""")
def agg1_time_bins(spark, sf_dir):
    """Ten-second bins from each record's start: linear and circular means, and whether any reading was deep."""
    df = with_heading(record(spark, sf_dir)).withColumn("deep", F.col("depth") > 20)
    out = aggregates.time_bins(df, 0.1, ["depth", "temp"], {"heading": 0.0}, ["deep"])
    return out.select("ID", F.unix_micros("datetime").alias("us"), r6(F.col("depth")).alias("depth"), r6(F.col("temp")).alias("temp"), (F.round("heading", 4) + 0.0).alias("heading"), F.col("deep").cast("bigint").alias("deep"))


@query(f"""with {TAG} select "ID", floor(us / 60000000)::bigint * 60000000 bin_us, {q('avg(depth)')} depth, {q('avg(temp)')} "temp" from tag group by all""")
def agg4_epoch_bins(spark, sf_dir):
    return rounded(aggregates.epoch_bins(record(spark, sf_dir), 60, ["depth", "temp"]))


_VV = """v as (select *, (coalesce(lead(depth) over w, depth) - coalesce(lag(depth) over w, depth)) / nullif(coalesce(lead(t) over w, t) - coalesce(lag(t) over w, t), 0) vv from tag window w as (partition by "ID" order by us))"""


@query(f"""with {TAG}, {_VV}, s as (select "ID", min(us) a, max(us) z, (max(t) - min(t)) / 3600 h, count(*) n, count(*) / count(distinct floor(t)) hz, avg(depth) dm, max(depth) dx, avg(temp) tm, min(temp) tn, max(temp) tx, max(vv) md, -min(vv) ma from v group by "ID"),
f as (select s."ID", count(*) n from s join positions p on p."ID" = s."ID" and epoch_us(p.datetime) between s.a and s.z group by s."ID")
select s."ID", a "start", z "end", {q('h')} duration_h, s.n, {q('hz')} sampling_hz, {q('dm')} depth_mean, {q('dx')} depth_max, {q('tm')} temp_mean, {q('tn')} temp_min, {q('tx')} temp_max, {q('md')} max_descent, {q('ma')} max_ascent, coalesce(f.n, 0) n_fixes from s left join f on s."ID" = f."ID" """)
def agg5_deployment_summary(spark, sf_dir):
    df = aggregates.vertical_speed(record(spark, sf_dir))
    out = aggregates.deployment_summary(df, table(spark, sf_dir, "positions"))
    return rounded(out.drop("vedba_mean", "odba_mean", "speed_mean", "speed_max", "tbf_mean", "pct_swimming"))


@query(f"""with {TAG}, s as (select "ID", avg(depth) depth_mean, max(depth) depth_max, avg(temp) temp_mean from tag group by "ID"),
l as (select 'depth_mean' variable, depth_mean x from s union all select 'depth_max', depth_max from s union all select 'temp_mean', temp_mean from s)
select variable, {q('avg(x)')} mean, {q('stddev_samp(x) / sqrt(count(x))')} se, count(x) n from l group by variable""")
def agg7_footer(spark, sf_dir):
    s = record(spark, sf_dir).groupBy("ID").agg(F.avg("depth").alias("depth_mean"), F.max("depth").alias("depth_max"), F.avg("temp").alias("temp_mean"))
    return rounded(aggregates.footer(s, ["depth_mean", "depth_max", "temp_mean"], "se"))


_EDGES = [float(e) for e in aggregates.DEPTH_EDGES]
_BIN = "1" + "".join(f" + (depth >= {e})::int" for e in _EDGES[1:-1])
_TAD = f"""{TAG}, g as (select *, lead(t) over (partition by "ID" order by us) - t gap from tag where depth is not null), m as (select "ID", median(case when gap > 0 then gap end) u from g group by "ID"),
w as (select g."ID", case when gap is null or gap > 5 * u then u else gap end ws, {_BIN} bin from g join m on g."ID" = m."ID"), h as (select "ID", bin, sum(ws) / 3600 hrs from w group by "ID", bin),
tad as (select "ID", bin, hrs, 100 * hrs / sum(hrs) over (partition by "ID") pct from h)"""


@query(f"""with {_TAD} select "ID", 'depth' variable, 'all' phase, bin, {q(f"list_extract({_EDGES[:-1]}, bin)")} bin_min, {q(f"list_extract({_EDGES[1:]}, bin)")} bin_max,
{q(f"(list_extract({_EDGES[:-1]}, bin) + list_extract({_EDGES[1:]}, bin)) / 2")} bin_mid, {q('hrs')} "hours", {q('pct')} pct from tad""")
def agg12_time_at_depth(spark, sf_dir):
    return rounded(aggregates.time_at(record(spark, sf_dir), "depth", _EDGES))


@query(f"""with {_TAD} select 'depth' variable, 'all' phase, bin, {q(f"list_extract({_EDGES[:-1]}, bin)")} bin_min, {q(f"list_extract({_EDGES[1:]}, bin)")} bin_max, {q('avg(pct)')} mean_pct, {q('stddev_samp(pct) / sqrt(count(pct))')} se_pct, count(pct) k from tad group by bin""")
def agg11_across_deployments(spark, sf_dir):
    return rounded(aggregates.across_deployments(aggregates.time_at(record(spark, sf_dir), "depth", _EDGES)))


@query(f"""with {TAG}, l as (select "ID", 'depth' metric, depth x from tag union all select "ID", 'temp', temp from tag)
select "ID", metric, count(x) n, {q('avg(x)')} mean, {q('median(x)')} median, {q('stddev_samp(x)')} sd, {q('quantile_cont(x, 0.05)')} q05, {q('quantile_cont(x, 0.25)')} q25, {q('quantile_cont(x, 0.75)')} q75, {q('quantile_cont(x, 0.95)')} q95, {q('min(x)')} "min", {q('max(x)')} "max" from l group by "ID", metric""")
def agg13_distributions(spark, sf_dir):
    return rounded(aggregates.distributions(record(spark, sf_dir), ["depth", "temp"]))


@query(f"with {TAG} select {q('median(temp)')} median, {q('avg(temp)')} mean, {q('quantile_cont(temp, 0.99)')} trim from tag")
def agg14_reference(spark, sf_dir):
    return rounded(aggregates.pooled_reference(record(spark, sf_dir), "temp"))


@query(f"""with {TAG}, {_TILT}, {_HEAD}, c as (select "ID", avg(sin(radians(heading))) s, avg(cos(radians(heading))) c from hd where heading is not null group by "ID")
select "ID", round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) + 0.0 mean, {q('sqrt(s*s + c*c)')} mrl, case when sqrt(s*s + c*c) >= 0.1 then round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) + 0.0 end guarded from c""")
def agg18_circular(spark, sf_dir):
    h = F.col("heading")
    out = with_heading(record(spark, sf_dir)).where("heading is not null").groupBy("ID").agg(angles.circular_mean(h).alias("mean"), angles.resultant_length(h).alias("mrl"), angles.guarded_mean(h).alias("guarded"))
    return out.select("ID", (F.round("mean", 4) + 0.0).alias("mean"), r6(F.col("mrl")).alias("mrl"), (F.round("guarded", 4) + 0.0).alias("guarded"))


@query(f"""with {TAG}, h as (select "ID", depth, temp from tag where depth is not null and temp is not null)
select "ID", count(*) n, round(regr_slope(temp, depth), 4) + 0.0 slope, round(regr_intercept(temp, depth), 4) + 0.0 intercept, round(regr_r2(temp, depth), 4) + 0.0 r2 from h group by "ID" """)
def agg23_regression(spark, sf_dir):
    h = record(spark, sf_dir).where("depth is not null and temp is not null")
    return h.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), (F.round(F.regr_slope("temp", "depth"), 4) + 0.0).alias("slope"), (F.round(F.regr_intercept("temp", "depth"), 4) + 0.0).alias("intercept"), (F.round(F.regr_r2("temp", "depth"), 4) + 0.0).alias("r2"))


@query(f"""with {TAG}, h as (select "ID", case when count(*) >= 3 and stddev_samp(depth) >= 1e-9 and stddev_samp(temp) >= 1e-9 then round(corr(depth, temp), 4) + 0.0 end r from tag where depth is not null and temp is not null group by "ID")
select i."ID", h.r from (select distinct "ID" from tag) i left join h on i."ID" = h."ID" """)
def agg24_correlation(spark, sf_dir):
    return record(spark, sf_dir).groupBy("ID").agg((F.round(aggregates.safe_corr(F.col("depth"), F.col("temp")), 4) + 0.0).alias("r"))


@query("""select "ID", arg_max(observer, case when event = 'feeding' and observer is not null then ann_id end) feeding, arg_max(observer, case when event = 'breach' and observer is not null then ann_id end) breach from annotations where observer is not null group by "ID" """)
def agg25_processing_summary(spark, sf_dir):
    """The latest parameters per step of a processing history (here: the latest observer per event)."""
    history = table(spark, sf_dir, "annotations").where("observer is not null").select("ID", F.col("ann_id").alias("seq"), F.col("event").alias("step"), F.lit("1").alias("version"), F.col("start").alias("time"), F.create_map(F.lit("observer"), F.col("observer")).alias("params"))
    out = tag.latest_steps(history, ["feeding", "breach"])
    return out.select("ID", F.col("feeding")["observer"].alias("feeding"), F.col("breach")["observer"].alias("breach"))


@query(f"""with v as (select "ID", interval_s m, count(*) v from sensor_files where interval_s is not null group by all), s as (select "ID", sum(v) voters, max(v) top, count(*) kinds, arg_min(m, -v * 1000000 + m) consensus from v group by "ID")
select "ID", 'interval' family, voters::bigint voters, consensus, {q('top / voters')} agreement, case when voters < 2 then 'insufficient' when kinds = 1 then 'agreed' when top / voters >= 0.6 then 'majority' else 'conflict' end status from s""")
def agg26_votes(spark, sf_dir):
    """Consensus of a deployment's files on their nominal interval."""
    p = table(spark, sf_dir, "sensor_files").where("interval_s is not null").select("ID", F.lit("interval").alias("family"), "interval_s")
    return rounded(aggregates.votes(p, "ID", "family", "interval_s"))


_CAL = """cal as (select pkg package_id, year(dt) y, abs(lat) / 100 slope, 0.5 + abs(lon) / 400 w from deployments where pkg is not null and dt is not null and lat is not null and lon is not null and lat > 0),
o as (select package_id, y, sum(slope * w) / sum(w) slope, sum(w) w from cal group by all), m as (select package_id, sum(y * w) / sum(w) ym, sum(slope * w) / sum(w) sm, min(y) y0, max(y) y1 from o group by package_id),
r as (select greatest(coalesce(sum(w * (y - ym) * (slope - sm)) / nullif(sum(w * (y - ym) * (y - ym)), 0), 0), 0) rate, sum(slope * w) / sum(w) alls, sum(y * w) / sum(w) ally from o join m using (package_id))"""


@query(f"""with {_CAL} select d."ID", {q('coalesce(o.slope, m.sm + r.rate * (year(d.dt) - m.ym), r.alls + r.rate * (year(d.dt) - r.ally))')} slope,
case when o.slope is not null then 'measured' when m.sm is not null then 'tag-model' else 'baseline' end source, {q('r.rate')} rate from deployments d cross join r left join o on d.pkg = o.package_id and year(d.dt) = o.y left join m on d.pkg = m.package_id where d.dt is not null""")
def agg27_paddle_slopes(spark, sf_dir):
    d = table(spark, sf_dir, "deployments").where("dt is not null").select("ID", F.col("pkg").alias("package_id"), F.year("dt").alias("year"), "lat", "lon")
    cal = d.where("package_id is not null and lat > 0 and lon is not null").select("package_id", "year", (F.abs("lat") / 100).alias("slope"), (0.5 + F.abs("lon") / 400).alias("r_squared"))
    out = aggregates.impute_slopes(cal, d.select("ID", "package_id", "year"), (0.0, 1e9))
    return rounded(out.select("ID", "slope", "source", "rate"))


# Windows


def _centred(k: int, names: list[str], extra: str = "") -> str:
    return f"rows between {(k - 1) // 2} preceding and {k // 2} following"


@query(f"""with {TAG}, d as (select * from tag where depth is not null), f as (select record_id, count(*) over c n, avg(depth) over c mean, stddev_samp(depth) over c sd, median(depth) over c med, max(depth) over c - min(depth) over c rg from d window c as (partition by "ID" order by us {_centred(6, [])}))
select record_id, case when n = 6 then {q('mean')} end mean, case when n = 6 then round(sd, 4) + 0.0 end sd, case when n = 6 then {q('med')} end median, case when n = 6 then {q('rg')} end "range" from f""")
def win1_rolling(spark, sf_dir):
    """Rolling statistics over six rows, NULL where the window is not whole."""
    df, w = record(spark, sf_dir).where("depth is not null"), windows.spec()
    x = F.col("depth")
    return df.select("record_id", r6(windows.rolling(x, w, 6, "mean")).alias("mean"), (F.round(windows.rolling(x, w, 6, "sd"), 4) + 0.0).alias("sd"), r6(windows.rolling(x, w, 6, "median")).alias("median"), r6(windows.rolling(x, w, 6, "range")).alias("range"))


@query(f"""with {TAG}, d as (select record_id, "ID", us, depth, row_number() over w i, count(*) over (partition by "ID") n, first_value(depth) over (partition by "ID" order by us) a, last_value(depth) over (partition by "ID" order by us rows between unbounded preceding and unbounded following) z,
sum(depth) over (partition by "ID" order by us rows between 2 preceding and 2 following) s from tag where depth is not null window w as (partition by "ID" order by us))
select record_id, {q('(s + greatest(2 - i + 1, 0) * a + greatest(2 - (n - i), 0) * z) / 5')} smooth from d""")
def win2_edge_mean(spark, sf_dir):
    df = record(spark, sf_dir).where("depth is not null")
    return df.select("record_id", r6(windows.edge_mean(F.col("depth"), windows.spec(), 5)).alias("smooth"))


@query(f"""with {TAG}, {_TILT}, {_HEAD}, c as (select record_id, avg(sin(radians(heading))) over w s, avg(cos(radians(heading))) over w c from hd where heading is not null window w as (partition by "ID" order by us rows between 2 preceding and 2 following))
select record_id, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 3) + 0.0 heading from c where s*s + c*c > 1e-6""")
def win3_rolling_circular(spark, sf_dir):
    df, w = with_heading(record(spark, sf_dir)).where("heading is not null"), windows.spec()
    f = w.rowsBetween(-2, 2)
    s, c = F.avg(F.sin(F.radians("heading"))).over(f), F.avg(F.cos(F.radians("heading"))).over(f)
    out = df.select("record_id", angles.over_frame(F.col("heading"), f).alias("h"), (s * s + c * c).alias("r2"))
    return out.where("r2 > 1e-6").select("record_id", (F.round("h", 3) + 0.0).alias("heading"))


@query(f"""with {TAG}, d as (select * from tag where depth is not null), {_VV.replace("from tag", "from d")}, j as (select record_id, vv, sqrt((ax - lag(ax) over w)**2 + (ay - lag(ay) over w)**2 + (az - lag(az) over w)**2) step from v window w as (partition by "ID" order by us))
select record_id, {q('vv')} vertical_velocity, {q('step')} accel_step from j""")
def win4_differences(spark, sf_dir):
    df, w = record(spark, sf_dir).where("depth is not null"), windows.spec()
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("ax", "ay", "az")), F.lit(0.0)))
    return df.select("record_id", r6(windows.central_rate(F.col("depth"), seconds(), w)).alias("vertical_velocity"), r6(step).alias("accel_step"))


@query(f"""with {TAG}, d as (select "ID", us, depth > 20 deep from tag where depth is not null), r as (select *, sum(case when p is null or p <> deep then 1 else 0 end) over (partition by "ID" order by us) run from (select *, lag(deep) over (partition by "ID" order by us) p from d)),
e as (select "ID", run, count(*) n, min(us) b, max(us) z from r where deep group by "ID", run), k as (select *, row_number() over (partition by "ID" order by n desc, b) x from e) select "ID", b "begin", z "end", n from k where x = 1""")
def win6_longest_run(spark, sf_dir):
    df = record(spark, sf_dir).where("depth is not null").select("ID", "datetime", (F.col("depth") > 20).alias("deep"))
    return rounded(windows.longest_run(df, "deep"))


@query(f"""with {TAG}, l as (select record_id, last_value(temp ignore nulls) over (partition by "ID" order by us rows between unbounded preceding and current row) locf, first_value(temp ignore nulls) over (partition by "ID" order by us rows between current row and unbounded following) nocb from tag) select record_id, locf, nocb from l""")
def win7_fill(spark, sf_dir):
    w = windows.spec()
    return record(spark, sf_dir).select("record_id", windows.locf(F.col("temp"), w).alias("locf"), windows.nocb(F.col("temp")).alias("nocb"))


@query(f"""with {TAG}, n as (select *, row_number() over (partition by "ID" order by us) i from tag),
k as (select record_id, us, i, t, temp, max(case when temp is not null then i end) over b i0, min(case when temp is not null then i end) over a i1,
last_value(case when temp is not null then t end ignore nulls) over b t0, first_value(case when temp is not null then t end ignore nulls) over a t1, last_value(temp ignore nulls) over b x0, first_value(temp ignore nulls) over a x1 from n
window b as (partition by "ID" order by us rows between unbounded preceding and current row), a as (partition by "ID" order by us rows between current row and unbounded following))
select record_id, {q('coalesce(temp, case when i1 - i0 - 1 <= 5 then x0 + (x1 - x0) * (t - t0) / (t1 - t0) end)')} "temp" from k""")
def win8_interpolate(spark, sf_dir):
    w = windows.spec()
    return record(spark, sf_dir).select("record_id", r6(windows.interpolate(F.col("temp"), seconds(), w, 5)).alias("temp"))


@query(f"""with {TAG}, m as (select record_id, "ID", us, case when depth > 30 then 1 when depth < 10 then 0 end m from tag) select record_id, coalesce(last_value(m ignore nulls) over (partition by "ID" order by us rows between unbounded preceding and current row), 0) state from m""")
def win11_hysteresis(spark, sf_dir):
    return record(spark, sf_dir).select("record_id", windows.hysteresis(F.col("depth"), F.lit(30), F.lit(10), windows.spec()).cast("bigint").alias("state"))


@query(f"""with {TAG}, d as (select record_id, "ID", us, depth, abs(depth - lag(depth) over (partition by "ID" order by us)) s from tag where depth is not null)
select record_id, {q('sum(coalesce(s, 0)) over w')} path, {q('max(depth) over w')} deepest from d window w as (partition by "ID" order by us rows between unbounded preceding and current row)""")
def win12_cumulative(spark, sf_dir):
    w = windows.spec()
    df = record(spark, sf_dir).where("depth is not null").withColumn("s", F.coalesce(F.abs(F.col("depth") - F.lag("depth").over(w)), F.lit(0.0)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select("record_id", r6(F.sum("s").over(upto)).alias("path"), r6(F.max("depth").over(upto)).alias("deepest"))


@query(f"""with {TAG}, b as (select record_id, row_number() over (partition by "ID", floor(us / 300000000) order by us) n from tag) select record_id from b where n = 1""")
def win13_first_per_bin(spark, sf_dir):
    return windows.first_per_bin(record(spark, sf_dir), F.floor(F.unix_micros("datetime") / 300_000_000)).select("record_id")


@query(f"""with {TAG}, n as (select *, row_number() over (partition by "ID" order by us) i from tag), s as (select "ID", case when temp is not null then i - max(case when temp is not null then i end) over (partition by "ID" order by us rows between unbounded preceding and 1 preceding) end d,
case when gx is not null then i - max(case when gx is not null then i end) over (partition by "ID" order by us rows between unbounded preceding and 1 preceding) end g from n), m as (select "ID", median(d) d, median(g) g from s group by "ID")
select "ID", 'temp' channel, d spacing, d > 1.5 sub_rate from m union all select "ID", 'gx', g, g > 1.5 from m""")
def win20_sub_rate(spark, sf_dir):
    return windows.sub_rate_channels(record(spark, sf_dir), ["temp", "gx"])


@query(f"""with {TAG}, {_TILT}, {_HEAD}, d as (select record_id, "ID", us, coalesce((((heading - lag(heading) over w + 180) % 360) + 360) % 360 - 180, heading) s from hd where heading is not null window w as (partition by "ID" order by us)),
u as (select record_id, sum(s) over (partition by "ID" order by us rows between unbounded preceding and current row) x from d) select record_id, round(x, 3) + 0.0 unwrapped from u""")
def win21_unwrap(spark, sf_dir):
    df = windows.unwrapped(with_heading(record(spark, sf_dir)).where("heading is not null"), "heading")
    return df.select("record_id", (F.round("unwrapped", 3) + 0.0).alias("unwrapped"))


@query(f"""with {TAG}, n as (select record_id, row_number() over (partition by "ID" order by us) i, count(*) over (partition by "ID") n from tag) select record_id from n where (i - 1) % greatest(ceil(n / 99.0), 1) = 0 or i = n""")
def srt7_stride(spark, sf_dir):
    return windows.stride_sample(record(spark, sf_dir), 100).select("record_id")


@query(f"""with {TAG}, s as (select "ID", median(depth) m from tag group by "ID") select "ID", {q('m')} median, row_number() over (order by m desc nulls last, "ID") place from s""")
def srt2_order(spark, sf_dir):
    """Deployments in order of their median depth, the deepest first."""
    s = record(spark, sf_dir).groupBy("ID").agg(F.percentile("depth", 0.5).alias("m"))
    # One row per deployment is ranked.
    return s.select("ID", r6(F.col("m")).alias("median"), F.row_number().over(Window.orderBy(F.col("m").desc_nulls_last(), "ID")).cast("bigint").alias("place"))


# Sets and functions


@query("""select "ID", 'video' kind, epoch_us("start") us from video_segments union all select "ID", 'annotation', epoch_us("start") from annotations""")
def set1_union(spark, sf_dir):
    v = table(spark, sf_dir, "video_segments").select("ID", F.lit("video").alias("kind"), F.unix_micros("start").alias("us"))
    return tag.fleet(v, table(spark, sf_dir, "annotations").select("ID", F.lit("annotation").alias("kind"), F.unix_micros("start").alias("us")))


@query("""select "ID" from (select distinct "ID" from annotations intersect select distinct "ID" from video_segments) except select distinct "ID" from positions where type = 'Argos'""")
def set3_intersect_except(spark, sf_dir):
    ids = {t: table(spark, sf_dir, t) for t in ("annotations", "video_segments", "positions")}
    return ids["annotations"].select("ID").intersect(ids["video_segments"].select("ID")).exceptAll(ids["positions"].where("type = 'Argos'").select("ID").distinct())


@query(f"""with {TAG}, s as (select "ID", us, us - lag(us) over (partition by "ID" order by us) dt from tag), g as (select "ID", min(us) a, max(us) z, round(median(case when dt > 0 then dt end))::bigint step from s group by "ID")
select "ID", step step_us, unnest(range(a, z + 1, step)) us from g where step > 0""")
def set6_grid(spark, sf_dir):
    return regularize.grid(record(spark, sf_dir)).select("ID", "step_us", F.unix_micros("datetime").alias("us"))


_HAV = "2 * 6371.0 * atan2(sqrt(pow(sin(radians(p.lat - d.lat) / 2), 2) + cos(radians(d.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - d.lon) / 2), 2)), sqrt(1 - (pow(sin(radians(p.lat - d.lat) / 2), 2) + cos(radians(d.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - d.lon) / 2), 2))))"


@query(f"""select p.pos_id, {q(_HAV)} km, round(((degrees(atan2(sin(radians(p.lon - d.lon)) * cos(radians(p.lat)), cos(radians(d.lat)) * sin(radians(p.lat)) - sin(radians(d.lat)) * cos(radians(p.lat)) * cos(radians(p.lon - d.lon)))) % 360) + 360) % 360, 4) + 0.0 bearing,
round(radians(p.lon - d.lon) * 6371000.0 * cos(radians(d.lat)), 3) + 0.0 east_m, round(radians(p.lat - d.lat) * 6371000.0, 3) + 0.0 north_m from positions p join deployments d on p."ID" = d."ID" where p.lon is not null and p.lat is not null and d.lon is not null""")
def fun_geo(spark, sf_dir):
    """Distance, bearing and local coordinates of each fix from its deployment."""
    d = table(spark, sf_dir, "deployments").where("lon is not null").select("ID", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    p = table(spark, sf_dir, "positions").where("lon is not null and lat is not null").join(d, "ID")
    c = [F.col(x) for x in ("lon0", "lat0", "lon", "lat")]
    e, n = geo.to_local(c[2], c[3], c[0], c[1])
    return p.select("pos_id", r6(geo.haversine_km(*c)).alias("km"), (F.round(geo.bearing(*c), 4) + 0.0).alias("bearing"), (F.round(e, 3) + 0.0).alias("east_m"), (F.round(n, 3) + 0.0).alias("north_m"))
