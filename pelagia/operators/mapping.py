"""How a tag's axes lie in the animal: scoring of all rotations, choice, consensus, review."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.functions.rotations import proper_rotations
from pelagia.operators.aggregates import epoch_bins, safe_corr
from pelagia.operators.tag import seconds
from pelagia.operators.windows import central_rate


def candidates(spark: SparkSession) -> DataFrame:
    """The 24 proper rotations: ``candidate, m`` (row-wise array of 9). The table is fixed."""
    return spark.createDataFrame([(k, [int(x) for x in np.asarray(m).ravel()]) for k, m in enumerate(proper_rotations())], "candidate int, m array<int>")


def second_means(data: DataFrame, columns: list[str], width_s: int = 1) -> DataFrame:
    """The record at 1 Hz or slower, which is enough to judge its axes."""
    return epoch_bins(data, width_s, columns).withColumn("datetime", F.timestamp_micros("bin_us")).drop("bin_us")


def scores(data: DataFrame) -> DataFrame:
    """Per ID and rotation ``tilt`` (median absolute roll and pitch plus distance of the vertical axis from 1 g), the
    ``surge`` correlation of pitch with vertical velocity, and n.

    The 24 rotations are expressions exploded per reduced row, not a join.
    """
    rows = second_means(data, ["ax", "ay", "az", "depth"]).where("ax is not null and ay is not null and az is not null")
    w = Window.partitionBy("ID").orderBy("datetime")
    rows = rows.withColumn("vv", central_rate(F.col("depth"), seconds(), w))
    all24 = F.array(*[F.struct(F.lit(k).alias("candidate"), *[sum((F.lit(float(m[r, c])) * F.col(a) for c, a in enumerate(("ax", "ay", "az")) if m[r, c]), F.lit(0.0)).alias("xyz"[r]) for r in range(3)]) for k, m in enumerate(proper_rotations())])
    e = rows.select("ID", "vv", F.explode(all24).alias("b")).select("ID", "vv", "b.*")
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    pitch, roll = F.degrees(F.atan2(-F.col("x"), F.sqrt(F.col("y") ** 2 + F.col("z") ** 2))), F.degrees(F.atan2("y", "z"))
    e = e.withColumn("pitch", pitch).withColumn("roll", roll).withColumn("g", size)
    # The middle of many seconds: an approximate percentile combines before the shuffle, an exact one would not.
    middle = lambda x: F.percentile_approx(x, 0.5, 1000)
    return e.groupBy("ID", "candidate").agg(middle(F.abs("roll")).alias("roll"), middle(F.abs("pitch")).alias("pitch"), middle(F.abs(F.col("z") - F.col("g"))).alias("off"), safe_corr(F.col("pitch"), F.col("vv"), 30).alias("surge"), F.count(F.lit(1)).alias("n")).withColumn("tilt", F.col("roll") + F.col("pitch") + 90 * F.col("off"))


def propose(scored: DataFrame, max_corr: float = -0.4, separation: float = 0.15) -> DataFrame:
    """Per ID the best rotation (least tilt among those whose pitch falls with descent), and whether it stands out:
    status ``resolved``, ``vertical_only`` or ``unresolved``. Ties go to the smaller number."""
    w = Window.partitionBy("ID").orderBy("tilt", F.coalesce("surge", F.lit(0.0)), "candidate")
    ranked = scored.withColumn("k", F.row_number().over(w)).where("k <= 4")
    best = ranked.groupBy("ID").agg(F.min_by(F.struct("candidate", "tilt", "surge"), F.struct(F.coalesce("surge", F.lit(0.0)), F.col("candidate"))).alias("b"), F.percentile_approx("surge", 0.5).alias("mid"), F.max("n").alias("n"))
    s = F.col("b.surge")
    status = F.when((s <= max_corr) & (F.abs(s - F.col("mid")) >= separation), "resolved").when(F.col("b.tilt") < 60, "vertical_only").otherwise("unresolved")
    return best.select("ID", "b.candidate", F.col("b.tilt").alias("tilt"), s.alias("surge"), status.alias("status"), "n")


def static_rows(data: DataFrame, limit: float = 0.1) -> DataFrame:
    """Rows whose acceleration is close to 1 g, and `stable`: all of the surrounding 5 rows are."""
    w = Window.partitionBy("ID").orderBy("datetime")
    still = F.abs(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2) - 1) < limit
    df = data.withColumn("static", F.coalesce(still, F.lit(False)))
    return df.withColumn("stable", F.sum(F.col("static").cast("int")).over(w.rowsBetween(-2, 2)) == 5)


def review_queue(proposals: DataFrame, consensus: DataFrame | None = None) -> DataFrame:
    """Proposals to look at: ``ID, reason, priority`` (1 is the most doubtful; the caller sorts)."""
    df = proposals
    conflict = F.lit(False)
    if consensus is not None:
        df = df.join(consensus.select("ID", F.col("candidate").alias("agreed")), "ID", "left")
        conflict = F.col("agreed").isNotNull() & (F.col("agreed") != F.col("candidate"))
    reason = F.when(conflict, "conflict").when(F.col("status") == "unresolved", "unresolved").when(F.col("status") == "vertical_only", "vertical_only")
    priority = F.when(reason == "conflict", 1).when(reason == "unresolved", 2).otherwise(3)
    return df.withColumn("reason", reason).where("reason is not null").select("ID", "reason", priority.alias("priority"))


def decided(data: DataFrame, decisions: DataFrame) -> DataFrame:
    """`data` without the IDs that a review excluded."""
    return data.join(decisions.where("decision = 'exclude'").select("ID"), "ID", "left_anti")
