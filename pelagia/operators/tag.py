"""Tag records: the fleet as one DataFrame, its metadata, processing history and issues."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ["ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz", "depth", "temp", "paddle_speed", "paddle_freq"]
ISSUES = "id string, check string, severity string, message string"
HISTORY = "ID string, seq bigint, step string, version string, time timestamp, params map<string,string>"


def fleet(*parts: DataFrame) -> DataFrame:
    """Union of records; columns that a record lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def record(data: DataFrame) -> DataFrame:
    """A clean record: NaN as NULL, rows without ID or datetime left out, one row per (ID, datetime).

    Of rows of one time the one with the smallest record_id stays (or any, without record_id). The choice is
    made in the order of the other windows, so it costs no exchange of its own.
    """
    doubles = {c for c, t in data.dtypes if t in ("double", "float")}
    clean = data.where("ID is not null and datetime is not null").select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in data.columns])
    order = [F.col("datetime"), *([F.col("record_id")] if "record_id" in data.columns else [])]
    w = Window.partitionBy("ID").orderBy(*order)
    return clean.withColumn("__before", F.lag("datetime").over(w)).where("__before is null or __before <> datetime").drop("__before")


def seconds(column: str = "datetime") -> Column:
    """Seconds since the epoch as double."""
    return F.unix_micros(column) / F.lit(1e6)


def build_tag(data: DataFrame, tag_id: str | None = None, rename: dict[str, str] | None = None, start: str | None = None, rate: float | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A record from a table in memory: renamed columns, an ID, and times made of start and rate if it has none.

    `rename` maps source to canonical names; two sources for one name, or a name that exists already, are
    errors, as is a missing required channel.
    """
    rename = rename or {}
    targets = list(rename.values())
    if len(set(targets)) < len(targets):
        raise ValueError("two columns are mapped to one name")
    clash = [t for s, t in rename.items() if t in data.columns and t not in rename and s != t]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    out = data.withColumnsRenamed(rename)
    if tag_id is not None:
        out = out.withColumn("ID", F.lit(tag_id))
    if "ID" not in out.columns:
        raise ValueError("no ID")
    if "datetime" not in out.columns:
        if start is None or not rate or "row" not in out.columns:
            raise ValueError("without datetime, a start, a rate and the row number (column `row`, from 0) are needed")
        out = out.withColumn("datetime", F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("row") * 1e6 / rate)).cast("bigint")))
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"required channels are missing: {missing}")
    return out


def sampling_rate(data: DataFrame) -> DataFrame:
    """Per ID: rows per distinct whole second (rounded), and one over the median step."""
    t = data.withColumn("__dt", seconds() - seconds_lag())
    return t.groupBy("ID").agg(
        F.round(F.count(F.lit(1)) / F.count_distinct(F.date_trunc("second", "datetime"))).alias("per_second"),
        (1 / F.nullif(F.percentile(F.when(F.col("__dt") > 0, F.col("__dt")), 0.5), F.lit(0.0))).alias("hz"),
    )


def seconds_lag() -> Column:
    return F.lag(seconds()).over(Window.partitionBy("ID").orderBy("datetime"))


def metadata(data: DataFrame, deployments: DataFrame) -> DataFrame:
    """One row per ID: span, rows, sensors present, and the deployment's own columns (NULL without one)."""
    channels = [c for c in CHANNELS if c in data.columns]
    seen = data.groupBy("ID").agg(
        F.min("datetime").alias("first_datetime"), F.max("datetime").alias("last_datetime"), F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws("+", *[F.when(F.count(c) > 0, F.lit(c)) for c in channels]).alias("sensors"),
    )
    one = deployments.where("ID is not null").groupBy("ID").agg(*[F.min(c).alias(c) for c in deployments.columns if c != "ID"])
    return seen.join(one, "ID", "left")


def update_biometrics(meta: DataFrame, table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """`meta` with values of `table` where it has one, and the IDs of `table` that `meta` lacks."""
    new = table.groupBy("ID").agg(*[F.max(c).alias(f"__{c}") for c in columns])
    out = meta.join(new, "ID", "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in meta.columns])
    return out, new.join(meta, "ID", "left_anti").select("ID")


def append_history(history: DataFrame, ids: DataFrame, step: str, params: dict, version: str = "0.1.0") -> DataFrame:
    """`history` with one more record for each ID of `ids`; the sequence goes on per ID."""
    last = history.groupBy("ID").agg(F.max("seq").alias("last"))
    values = F.create_map(*[F.lit(x) for k, v in sorted(params.items()) for x in (k, v if isinstance(v, str) else json.dumps(v))]) if params else F.create_map().cast("map<string,string>")
    new = ids.select("ID").distinct().join(last, "ID", "left").select("ID", (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("seq"), F.lit(step).alias("step"), F.lit(version).alias("version"), F.current_timestamp().alias("time"), values.alias("params"))
    return history.unionByName(new)


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY)


def latest_steps(history: DataFrame, steps: list[str]) -> DataFrame:
    """One row per ID: for each step its latest parameters (NULL if it was not run) and `flags`, the steps run."""
    latest = history.groupBy("ID").agg(*[F.max_by("params", F.when(F.col("step") == s, F.col("seq"))).alias(s) for s in steps], F.concat_ws(",", *[F.max(F.when(F.col("step") == s, F.lit(s))) for s in steps]).alias("flags"))
    return latest


def flatten_history(history: DataFrame) -> DataFrame:
    """One row per parameter of each step; steps without parameters have one row."""
    return history.select("ID", "seq", "step", "version", "time", F.explode_outer("params").alias("key", "value"))


def heading_trust(status: Column) -> Column:
    """How far a heading can be trusted, from the status of the magnetometer's calibration."""
    # Status and trust.
    table = {"applied": "trusted", "applied_inline": "trusted", "proposed": "partial", "raw": "untrusted", "failed": "untrusted", "no_mag": "none", "not_applicable": "not_applicable"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), status), F.lit("unknown"))


def group_key(fields: list[str], separator: str = "|") -> Column:
    """A composite key; NULL if one of its fields is."""
    return F.when(F.expr(" and ".join(f"{f} is not null" for f in fields)), F.concat_ws(separator, *fields))


def complete_roster(summary: DataFrame, roster: DataFrame) -> DataFrame:
    """`summary` with the roster's other IDs appended, status ``excluded``, in the order of the roster's `position`."""
    known = summary.withColumn("status", F.lit("included"))
    return roster.select("ID", "position").join(known, "ID", "left").withColumn("status", F.coalesce("status", F.lit("excluded"))).orderBy(F.col("position").asc_nulls_last(), "ID").drop("position")
