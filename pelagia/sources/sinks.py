"""Records to storage and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_records(data: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite", salt: int = 1) -> str:
    """Parquet, partitioned by ID and sorted by time inside the files. `salt` spreads each ID's rows over that many
    tasks by time, for IDs that hold a large share of the rows."""
    day = F.floor(F.unix_micros("datetime") / 86_400_000_000)
    spread = data.repartition(F.col("ID"), F.pmod(day, F.lit(salt))) if salt > 1 else data.repartition("ID")
    spread.sortWithinPartitions("ID", "datetime").write.mode(mode).option("compression", compression).partitionBy("ID").parquet(path)
    return path


def load_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records saved before; a filter on ID reads only its folders."""
    out = None
    for p in paths:
        part = spark.read.parquet(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("ID", F.col("ID").cast("string"))


def output(data: DataFrame, path: str | None, return_data: bool = True):
    """The data, or the path it was saved to; neither is an error."""
    if path is None and not return_data:
        raise ValueError("without return_data a path is needed")
    if path is not None:
        save_records(data, path)
    return data if return_data else path
