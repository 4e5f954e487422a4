"""Time joins: nearest and backward as-of, snapping, intervals. All are unions with windows or bucketed
equi-joins; none compares every pair of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("__t", F.unix_micros(order))


def as_of(left: DataFrame, right: DataFrame, values: list[str], direction: str = "nearest", tolerance_us: int | None = None, key: str = "ID", order: str = "datetime", cell_us: int = 86_400_000_000) -> DataFrame:
    """`left` with `values` of the right row nearest in time (or the last one not later: ``backward``).

    Both sides meet per key and cell of time, so a key that holds most rows is spread over its cells; into each cell the
    last right row before it and the first one behind it are carried (found among one row per key and cell). Of two
    equally near rows the earlier is taken, of right rows of one time the one with the largest values. Beyond the
    tolerance the values are NULL. Columns of the left side keep their names; a value with the name of a left column is
    an error. Left rows with a NULL key or time have NULL values.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns exist on both sides: {sorted(clash)}")
    packed = F.struct(F.col("__t").alias("t"), *[F.col(v) for v in values])
    a = _numbered(left, order).select(F.col(key).alias("__k"), "__t", F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).alias("__right"))
    b = _numbered(right, order).where(f"{key} is not null and __t is not null").select(F.col(key).alias("__k"), "__t", F.lit(0).alias("__side"), F.lit(None).alias("__left"), packed.alias("__right"))
    both = a.unionByName(b).withColumn("__cell", F.expr(f"floor(__t / {cell_us})"))
    ends = both.groupBy("__k", "__cell").agg(F.max("__right").alias("last"), F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct(-F.col("__t"), F.col("__right")))).alias("first"))
    cells = Window.partitionBy("__k")
    earlier = F.last("last", ignorenulls=True).over(cells.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("first", ignorenulls=True).over(cells.orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__k", "__cell", F.array_compact(F.array(earlier, *([later] if direction == "nearest" else []))).alias("__rights")).select("__k", "__cell", F.explode("__rights").alias("__right"))
    carried = carried.select("__k", F.col("__right.t").alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__left"), "__right", "__cell")
    w = Window.partitionBy("__k", "__cell").orderBy("__t", "__side", "__right")
    before = F.last("__right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    met = both.unionByName(carried).withColumn("__a", before)
    if direction == "nearest":
        back = Window.partitionBy("__k", "__cell").orderBy(F.desc("__t"), F.desc("__side"), F.asc("__right"))
        behind = F.last("__right", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("__b", behind)
        da, db = F.col("__t") - F.col("__a.t"), F.col("__b.t") - F.col("__t")
        met = met.withColumn("__x", F.when(F.col("__b").isNull() | (da <= db), F.col("__a")).otherwise(F.col("__b")))
    else:
        met = met.withColumn("__x", F.col("__a"))
    known = F.col("__k").isNotNull() & F.col("__t").isNotNull()
    if tolerance_us is not None:
        known = known & (F.abs(F.col("__x.t") - F.col("__t")) <= tolerance_us)
    met = met.withColumn("__x", F.when(known, F.col("__x")))
    return met.where("__side = 1").select("__left.*", *[F.col(f"__x.{v}").alias(v) for v in values])


def snap_to_rows(fixes: DataFrame, rows: DataFrame, tolerance_us: int | None = None, key: str = "ID", order: str = "datetime", fix_id: str = "pos_id") -> DataFrame:
    """Each fix within its record's span on the nearest row: ``ID, datetime, <fix_id>``; of fixes on one row the
    latest stays."""
    span = rows.groupBy(key).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    inside = fixes.join(span, key).where(F.col(order).between(F.col("__lo"), F.col("__hi"))).select(key, order, fix_id)
    met = as_of(inside, rows.select(key, order, F.col(order).alias("row_time")), ["row_time"], "nearest", tolerance_us, key, order)
    return met.where("row_time is not null").groupBy(key, F.col("row_time").alias(order)).agg(F.max_by(fix_id, F.struct(order, fix_id)).alias(fix_id))


def cells_of(start: Column, end: Column, width_us: int) -> Column:
    """The time cells that an interval of microseconds touches."""
    return F.sequence(F.floor(start / width_us).cast("bigint"), F.floor(end / width_us).cast("bigint"))


def in_intervals(rows: DataFrame, intervals: DataFrame, keys: list[str], start: str, end: str, order: str = "datetime", carry: list[str] | None = None, width_us: int = 3_600_000_000) -> DataFrame:
    """Rows paired with the intervals of their keys that contain them (both bounds inclusive).

    An equi-join on the keys and an hour of time, not a comparison of all rows with all intervals. Intervals
    with a NULL or reversed bound are left out. An interval over n hours is sent to n cells.
    """
    carry = carry or []
    i = intervals.select(*keys, F.unix_micros(start).alias("__s"), F.unix_micros(end).alias("__e"), *[F.col(c).alias(f"__i_{c}") for c in carry]).where("__s <= __e")
    i = i.withColumn("__cell", F.explode(cells_of(F.col("__s"), F.col("__e"), width_us)))
    r = rows.withColumn("__t", F.unix_micros(order)).withColumn("__cell", F.floor(F.col("__t") / width_us).cast("bigint"))
    met = r.join(i, [*keys, "__cell"]).where("__t between __s and __e")
    return met.select(*rows.columns, *[F.col(f"__i_{c}").alias(c) for c in carry])


def flag_intervals(rows: DataFrame, intervals: DataFrame, events: list[str], key: str = "ID", event: str = "event", start: str = "start", end: str = "end", order: str = "datetime", width_us: int = 3_600_000_000) -> DataFrame:
    """`rows` with a 0/1 column per event: 1 where one of the key's intervals of the event contains the time.

    Overlapping intervals first become continuous periods (they are few per key and hour), which are kept as one
    array per (key, cell), so each row is joined once and stays one row. An event named like a column is an
    error.
    """
    clash = set(events) & set(rows.columns)
    if clash:
        raise ValueError(f"events are named like columns: {sorted(clash)}")
    from pelagia.operators.intervals import continuous_periods

    us = intervals.where(F.col(event).isin(events)).select(F.col(key).cast("string").alias(key), F.col(event).cast("string").alias("__event"), F.unix_micros(start).alias("__s"), F.unix_micros(end).alias("__e"))
    periods = continuous_periods(us, [key, "__event"], "__s", "__e")
    cells = periods.withColumn("__cell", F.explode(cells_of(F.col("start_us"), F.col("end_us"), width_us)))
    per_cell = cells.groupBy(key, "__cell").agg(*[F.collect_list(F.when(F.col("__event") == e, F.struct("start_us", "end_us"))).alias(f"__{n}") for n, e in enumerate(events)])
    r = rows.withColumn("__t", F.unix_micros(order)).withColumn("__cell", F.floor(F.col("__t") / width_us).cast("bigint"))
    met = r.join(per_cell, [key, "__cell"], "left")
    return met.select(*rows.columns, *[F.coalesce(F.expr(f"exists(__{n}, i -> __t between i.start_us and i.end_us)"), F.lit(False)).cast("int").alias(e) for n, e in enumerate(events)])


def keep_in_intervals(rows: DataFrame, intervals: DataFrame, key: str = "ID", start: str = "start", end: str = "end", order: str = "datetime") -> DataFrame:
    """Rows inside the union of their key's intervals."""
    flagged = flag_intervals(rows, intervals.select(key, F.lit("__inside").alias("event"), F.col(start).alias("start"), F.col(end).alias("end")), ["__inside"], key, order=order)
    return flagged.where("__inside = 1").drop("__inside")


def first_interval(points: DataFrame, intervals: DataFrame, name: str, point_id: str, key: str = "ID", start: str = "start", end: str = "end", order: str = "datetime") -> DataFrame:
    """``<point_id>, <name>``: the first interval (by start, then name) that contains each point, in whole seconds."""
    second = [F.timestamp_micros(F.floor(F.unix_micros(c) / 1_000_000).cast("bigint") * 1_000_000) for c in (order, start, end)]
    p = points.withColumn(order, second[0])
    i = intervals.withColumn(start, second[1]).withColumn(end, second[2]).withColumn("__s", F.col(start))
    met = in_intervals(p, i, [key], start, end, order, [name, "__s"])
    return met.groupBy(point_id).agg(F.min_by(name, F.struct("__s", name)).alias(name))


def overlapping_next(df: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """Consecutive rows of a key whose next start lies before this end: ``<row_id>, next_id``."""
    w = Window.partitionBy(key).orderBy(start, row_id)
    n = df.where(f"{key} is not null and {start} is not null").withColumn("next_start", F.lead(start).over(w)).withColumn("next_id", F.lead(row_id).over(w))
    return n.where(F.col("next_start") < F.col(end)).select(row_id, "next_id")


def prioritised(left: DataFrame, right: DataFrame, keys: list[str], value: str, also: list[str]) -> DataFrame:
    """`left` with `value` of the right row that matches the first possible key of `keys` (and all of `also`)."""
    out = left
    for n, k in enumerate(keys):
        one = right.where(F.col(k).isNotNull()).groupBy(k, *also).agg(F.min(value).alias(f"__v{n}"))
        out = out.join(one, [k, *also], "left")
    return out.select(*left.columns, F.coalesce(*[F.col(f"__v{n}") for n in range(len(keys))]).alias(value))
