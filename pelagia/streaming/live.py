"""Streaming forms of the time operators, for records that arrive while they are made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SCHEMA = "ID string, datetime timestamp, value double, on int"


def tumbling(stream: DataFrame, width: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """Means per ID and window; rows later than the watermark are left out."""
    return stream.withWatermark("datetime", late).groupBy("ID", F.window("datetime", width)).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))


def sliding(stream: DataFrame, width: str, slide: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("datetime", late).groupBy("ID", F.window("datetime", width, slide)).agg(*[F.avg(c).alias(c) for c in columns])


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches without a gap longer than `gap`, per ID."""
    return stream.withWatermark("datetime", late).groupBy("ID", F.session_window("datetime", gap)).agg(F.count(F.lit(1)).alias("n"))


def hysteresis(stream: DataFrame, value: str, high: float, low: float) -> DataFrame:
    """``ID, datetime, value, on``: the two-threshold state of each reading, kept per ID between micro-batches.

    Rows are taken in time order within a micro-batch; a NULL value keeps the state.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values("datetime")
            out = []
            for v in frame[value]:
                if pd.notna(v):
                    on = 1 if v > high else 0 if v < low else on
                out.append(on)
            yield pd.DataFrame({"ID": frame["ID"], "datetime": frame["datetime"], "value": frame[value], "on": out})
        state.update((on,))

    return stream.select("ID", "datetime", F.col(value).alias(value)).groupBy("ID").applyInPandasWithState(step, _SCHEMA, "on int", "append", "NoTimeout")


def read_folder(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
