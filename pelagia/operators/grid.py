"""Irregular readings onto a regular grid: pair, explode the grid times between, fill or mark.

The grid of a source (ID, file_no) with nominal interval `i` seconds has the periods
``[k*i, (k+1)*i)`` since the epoch. It runs from the period of the source's first row to that of its last
row, whether or not these rows carry a value.

Readings are first aggregated per period (a combining aggregation, so duplicates and bursts vanish before
the shuffle). `lead` then pairs consecutive occupied periods and only the grid times *between* the two are
exploded. Sources are cut into cells of `cell` periods: pairs inside a cell are found in a window per
cell, pairs that span cells in a second window over one row per cell, so no task ever holds a whole
large source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.runtime import unfold

KEYS = ["ID", "file_no", "channel"]


def _periods(data: DataFrame, files: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """One row per source and period that holds a row: sums and counts of the valid values per channel."""
    step = files.select("ID", F.col("file_no").cast("bigint").alias("file_no"), F.col("interval_s").cast("bigint").alias("i")).where("i > 0 and ID is not null and file_no is not null").groupBy("ID", "file_no").agg(F.min("i").alias("i"))
    rows = data.select("ID", F.col("file_no").cast("bigint").alias("file_no"), F.unix_micros("datetime").alias("us"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in channels]).where("us is not null")
    joined = rows.join(step, ["ID", "file_no"]).withColumn("k", F.expr("floor(us / (i * 1000000))").cast("bigint"))
    return joined.groupBy("ID", "file_no", "i", "k").agg(*[F.count(c).alias(f"n_{c}") for c in channels], *[F.sum(c).alias(f"s_{c}") for c in channels])


def regular_grid(data: DataFrame, files: DataFrame, channels: tuple[str, ...] = ("depth", "ax"), max_fill: int = 3, cell: int = 4096) -> DataFrame:
    """Rows ``ID, file_no, channel, period_epoch, value, state`` for every grid period of every source.

    `state` is ``observed`` (value is the mean of the period's valid readings), ``filled`` (a gap of at
    most `max_fill` periods between two observed ones, linear interpolation), ``gap`` (a longer gap, NULL)
    or ``edge`` (before the first or after the last valid value of the channel, NULL). A channel without
    any valid value is all ``edge``. NULL and NaN values do not count; rows with a NULL datetime, ID or
    file_no, and sources without a positive nominal interval, have no grid. Empty tables give an empty grid.
    """
    seen = _periods(data, files, channels)
    per_channel = seen.select("ID", "file_no", "i", "k", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"n_{c}").alias("n"), (F.col(f"s_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))).alias("value")) for c in channels])).alias("x")).select("ID", "file_no", "i", "k", "x.*")
    per_channel = per_channel.withColumn("cell", F.expr(f"floor(k / {cell})").cast("bigint"))
    valid = per_channel.where("n > 0").select(*KEYS, "i", "cell", "k", "value")
    inside = Window.partitionBy(*KEYS, "cell").orderBy("k")
    pairs = valid.select("*", F.lead("k").over(inside).alias("k2"), F.lead("value").over(inside).alias("value2"))
    between_inside = pairs.where("k2 > k + 1").select(*KEYS, "i", "k", "value", "k2", "value2")
    # One row per cell: the first and last occupied period of it, and the first and last period of any row.
    ends = per_channel.groupBy(*KEYS, "i", "cell").agg(
        F.min("k").alias("row_lo"), F.max("k").alias("row_hi"),
        F.min(F.when(F.col("n") > 0, F.struct("k", "value"))).alias("lo"), F.max(F.when(F.col("n") > 0, F.struct("k", "value"))).alias("hi"),
    )
    across = Window.partitionBy(*KEYS).orderBy("cell")
    spans = ends.where("hi is not null").select(*KEYS, "i", F.col("hi.k").alias("k"), F.col("hi.value").alias("value"), F.lead("lo.k").over(across).alias("k2"), F.lead("lo.value").over(across).alias("value2")).where("k2 > k + 1")
    length = F.col("k2") - F.col("k")
    state = F.when(length - 1 <= max_fill, F.lit("filled")).otherwise(F.lit("gap"))
    lerp = F.when(length - 1 <= max_fill, F.col("value") + (F.col("value2") - F.col("value")) * (F.col("g") - F.col("k")) / length)
    filled = unfold(between_inside.unionByName(spans), "k + 1", "k2 - 1", "g", cell).select(*KEYS, "i", F.col("g").alias("k"), lerp.alias("value"), state.alias("state"))
    total = ends.groupBy(*KEYS, "i").agg(F.min("row_lo").alias("a"), F.max("row_hi").alias("z"), F.min("lo.k").alias("first"), F.max("hi.k").alias("last"))
    runs = F.when(F.col("first").isNull(), F.array(F.struct(F.col("a").alias("p"), F.col("z").alias("q")))).otherwise(F.array(F.struct(F.col("a").alias("p"), (F.col("first") - 1).alias("q")), F.struct((F.col("last") + 1).alias("p"), F.col("z").alias("q"))))
    edges = unfold(total.select(*KEYS, "i", F.inline(runs)), "p", "q", "k", cell).select(*KEYS, "i", "k", F.lit(None).cast("double").alias("value"), F.lit("edge").alias("state"))
    observed = valid.select(*KEYS, "i", "k", "value", F.lit("observed").alias("state"))
    return observed.unionByName(filled).unionByName(edges).select(*KEYS, (F.col("k") * F.col("i")).alias("period_epoch"), "value", "state")


def empty_periods(data: DataFrame, files: DataFrame, channels: tuple[str, ...] = ("depth", "ax")) -> DataFrame:
    """The grid periods without a valid value: ``ID, file_no, channel, period_epoch``."""
    return regular_grid(data, files, channels).where("state <> 'observed'").select(*KEYS, "period_epoch")
