"""Small helpers around the session: lineage cuts, table loading, hashing."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one named by ``spark.checkpoint.dir``.

    A session on a cluster has to name one. Where none is named and all runs in this process (master ``local``, as in
    tests) it is a folder of the process, which is deleted when the process ends.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = per_process("own checkpoint folder", _own_folder)
    return named


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="pelagia-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the cluster's shared checkpoint folder and forget its lineage. It survives the loss of
    executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores: a small table in one file would else be one task.
    A table that is read in enough partitions is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def unfold(df: DataFrame, first: str, last: str, name: str, width: int = 4096) -> DataFrame:
    """`df` with one row per whole number `name` from `first` to `last` (SQL expressions; none if first > last). It is done
    in stretches of `width`, so no array grows with the distance."""
    first, last = f"({first})", f"({last})"
    stretches = df.where(f"{first} <= {last}").withColumn("__stretch", F.explode(F.expr(f"sequence(floor({first} / {width}), floor({last} / {width}))")))
    return stretches.withColumn(name, F.explode(F.expr(f"sequence(greatest({first}, __stretch * {width}), least({last}, __stretch * {width} + {width - 1}))"))).drop("__stretch")


def clean(column) -> "F.Column":
    """A reading with NaN turned into NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(column), column)


def per_process(key, make):
    """What `make` returns, made once per Python worker process and `key`, and kept between its tasks."""
    kept = sys.modules.setdefault("_pelagia_kept", types.ModuleType("_pelagia_kept")).__dict__.setdefault("items", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
