"""Queries over the project's tables for the problems tagged llm, with SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import languages, leaks, nearest, quantiles, tokens
from pelagia.runtime import clean, table

TOKENIZERS = os.environ.get("PELAGIA_TOKENIZERS", "/opt/tokenizers")
TOLERANCE_US = 30_000_000


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = table(spark, sf_dir, "positions").select(F.col("ID").alias("entity"), F.unix_micros("datetime").alias("t_us"), F.col("pos_id").alias("rid"))
    readings = table(spark, sf_dir, "sensor_data").where(clean("pseudo_lon").isNotNull() & clean("pseudo_lat").isNotNull()).select(F.col("ID").alias("entity"), F.unix_micros("datetime").alias("t_us"), F.col("record_id").alias("rid"))
    return nearest.nearest_in_time(fixes, readings, TOLERANCE_US).select(F.col("query_id").alias("pos_id"), F.col("found_id").alias("record_id"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "sensor_data")
    return data.select("ID", F.col("file_no").cast("string").alias("file_no"), F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), clean(c).alias("value")) for c in ("depth", "temp")])).alias("x")).select("ID", "file_no", "x.*")


PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ID and channel: summaries per file, merged to one per ID."""
    files = quantiles.summarise(_readings(spark, sf_dir), ["ID", "file_no", "channel"], "value")
    return quantiles.percentiles(quantiles.combine(files, ["ID", "channel"]), ["ID", "channel"], PERCENTILES)


def p7_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile's true rank lies within the reported error, counted over all rows."""
    found = p7_percentiles(spark, sf_dir)
    values = _readings(spark, sf_dir).where("value is not null").select("ID", "channel", "value")
    met = values.join(found, ["ID", "channel"])
    ranks = met.groupBy("ID", "channel").agg(F.count("value").alias("rows"), F.max("rank_error").alias("err"), F.max("n").alias("n"), *[F.count_if(F.col("value") < F.col(p)).alias(f"lt_{p}") for p in PERCENTILES], *[F.count_if(F.col("value") <= F.col(p)).alias(f"le_{p}") for p in PERCENTILES])
    inside = F.col("n") == F.col("rows")
    for p, at in PERCENTILES.items():
        want = 1 + at * (F.col("rows") - 1)
        inside = inside & (F.col(f"lt_{p}") + 1 - F.col("err") <= want) & (F.col(f"le_{p}") + F.col("err") >= want)
    return ranks.select("ID", "channel", "n", (inside & (F.col("err") <= 1 + 0.005 * F.col("n"))).alias("within"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(table(spark, sf_dir, "documents"))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.assign_languages(table(spark, sf_dir, "documents")).select("doc_id", "para_no", "lang", "confidence")


SQL = {
    "p3_found": """
with s as (select "ID", epoch_us(datetime) t, record_id from sensor_data where pseudo_lon is not null and not isnan(pseudo_lon) and pseudo_lat is not null and not isnan(pseudo_lat)),
f as (select "ID", epoch_us(datetime) t, pos_id from positions where datetime is not null),
m as (select pos_id, record_id, row_number() over (partition by pos_id order by abs(s.t - f.t), s.t, record_id) n
  from f join s on f."ID" = s."ID" and s.t between f.t - 30000000 and f.t + 30000000)
select pos_id, record_id from m where n = 1""",
    "p7_within_bound": """
with r as (select "ID", 'depth' channel, depth v from sensor_data union all select "ID", 'temp', temp from sensor_data)
select "ID", channel, count(*) n, true "within" from r where v is not null and not isnan(v) group by "ID", channel""",
}

QUERIES = {f.__name__: f for f in (p3_found, p7_percentiles, p8_ids, p9_found, p10_found, p7_within_bound, p10_languages)}
