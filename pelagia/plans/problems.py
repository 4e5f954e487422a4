"""Queries over the project's tables for the general data problems, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import grid, intervals, spikes, timestamps, unit_texts
from pelagia.plans import domain_sql
from pelagia.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_implausible(table(spark, sf_dir, "sensor_data")).select("record_id", "channel").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.empty_periods(table(spark, sf_dir, "sensor_data"), table(spark, sf_dir, "sensor_files"))


def p2_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.regular_grid(table(spark, sf_dir, "sensor_data"), table(spark, sf_dir, "sensor_files"))
    return out.withColumn("value", F.round("value", 6) + F.lit(0.0))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_texts.units_to_convert(table(spark, sf_dir, "sensor_data"), table(spark, sf_dir, "sensor_files"))


def p4_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = unit_texts.to_common_units(table(spark, sf_dir, "sensor_data"), table(spark, sf_dir, "sensor_files"))
    return data.select("record_id", "ID", "file_no", *[(F.round(F.when(~F.isnan(c), F.col(c)), 6) + F.lit(0.0)).alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")])


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = table(spark, sf_dir, "video_segments").select(F.lit("video_segments").alias("tbl"), "ID", F.lit("video").alias("event"), F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"))
    notes = table(spark, sf_dir, "annotations").select(F.lit("annotations").alias("tbl"), "ID", "event", F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"))
    return video.unionByName(notes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods_and_gaps(_intervals(spark, sf_dir), ["tbl", "ID", "event"], "s", "e").select("tbl", "ID", "event", "kind", "start_us", "end_us")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.to_instants(table(spark, sf_dir, "raw_sensor"), table(spark, sf_dir, "deployments"))


_GRID = """
with r as (select s."ID", s.file_no, f.interval_s i, floor(epoch_us(s.datetime) / (f.interval_s * 1000000.0))::bigint k,
    case when not isnan(s.depth) then s.depth end depth, case when not isnan(s.ax) then s.ax end ax
  from sensor_data s join sensor_files f on s."ID" = f."ID" and s.file_no = f.file_no),
c as (select "ID", file_no, i, k, 'depth' channel, depth v from r union all select "ID", file_no, i, k, 'ax', ax from r),
o as (select "ID", file_no, i, channel, k, avg(v) v from c where v is not null group by all),
e as (select "ID", file_no, i, channel, unnest(range(min(k), max(k) + 1)) k from c group by "ID", file_no, i, channel),
g as (select e.*, o.v from e left join o on e."ID" = o."ID" and e.file_no = o.file_no and e.channel = o.channel and e.k = o.k)
"""

SQL = {
    "p2_found": _GRID + 'select "ID", file_no, channel, k * i period_epoch from g where v is null',
    "p2_series": _GRID + """,
w as (select *, max(case when v is not null then k end) over b k0, min(case when v is not null then k end) over a k1,
    last_value(v ignore nulls) over b v0, first_value(v ignore nulls) over a v1 from g
  window b as (partition by "ID", file_no, channel order by k rows between unbounded preceding and current row),
    a as (partition by "ID", file_no, channel order by k rows between current row and unbounded following))
select "ID", file_no, channel, k * i period_epoch,
  round(case when v is not null then v when k0 is null or k1 is null or k1 - k0 - 1 > 3 then null else v0 + (v1 - v0) * (k - k0) / (k1 - k0) end, 6) + 0.0 "value",
  case when v is not null then 'observed' when k0 is null or k1 is null then 'edge' when k1 - k0 - 1 <= 3 then 'filled' else 'gap' end state
from w""",
    "p4_found": domain_sql.SQL["p4_found"],
    "p4_converted": domain_sql.SQL["p4_converted"],
    "p5_found": """
with i as (select 'video_segments' tbl, "ID", 'video' event, epoch_us("start") s, epoch_us("end") e from video_segments
  union all select 'annotations', "ID", event, epoch_us("start"), epoch_us("end") from annotations),
v as (select * from i where e >= s),
m as (select *, max(e) over (partition by tbl, "ID", event order by s, e rows between unbounded preceding and 1 preceding) reach from v),
c as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by tbl, "ID", event order by s, e rows unbounded preceding) n from m),
p as (select tbl, "ID", event, n, min(s) s, max(e) e from c group by tbl, "ID", event, n),
g as (select *, lead(s) over (partition by tbl, "ID", event order by s) s2 from p)
select tbl, "ID", event, 'period' kind, s start_us, e end_us from p
union all select tbl, "ID", event, 'gap', e, s2 from g where s2 - e <= 6 * 3600 * 1000000::bigint""",
}

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p5_found, p6_found, p2_series, p4_converted)}
