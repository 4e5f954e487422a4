"""Readers of logger folders: CSV dialects, clock-less text logs, satellite files, sidecars, video inventories.

Headers and listings are read on the driver (one line per file); data is read by Spark, one scan per header
signature. Readers are registered with a test of whether they fit a folder; ``auto`` needs exactly one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.functions.names import filename_time
from pelagia.functions.units import convert, normalise_header
from pelagia.operators.tag import CHANNELS, fleet

MISSING = ["NA", "", "NULL", "NaN", "-"]
# Normalised header words of each channel, without unit.
SYNONYMS = {
    "datetime": ["datetime", "timestamp", "date time"], "date": ["date", "date (utc)"], "time": ["time", "time (utc)", "t"],
    "ax": ["ax", "acc x", "accel x", "acceleration x", "accelerometer x"], "ay": ["ay", "acc y", "accel y", "acceleration y", "accelerometer y"], "az": ["az", "acc z", "accel z", "acceleration z", "accelerometer z"],
    "gx": ["gx", "gyr x", "gyro x", "gyroscope x"], "gy": ["gy", "gyr y", "gyro y", "gyroscope y"], "gz": ["gz", "gyr z", "gyro z", "gyroscope z"],
    "mx": ["mx", "mag x", "magnetometer x"], "my": ["my", "mag y", "magnetometer y"], "mz": ["mz", "mag z", "magnetometer z"],
    "depth": ["depth", "pressure"], "temp": ["temp", "temp.", "temperature"], "paddle_speed": ["speed", "paddle speed"], "paddle_freq": ["paddle freq", "paddle"],
}
# Units as headers spell them, without brackets.
UNIT_WORDS = {"m/s2": "m/s2", "m/s²": "m/s2", "g": "g", "mg": "mg", "deg/s": "deg/s", "dps": "deg/s", "rad/s": "rad/s", "mrad/s": "mrad/s", "nt": "nT", "ut": "uT", "m": "m", "dbar": "dbar", "bar": "bar", "degc": "C", "c": "C", "f": "F", "k": "K", "m/s": "m/s", "km/h": "km/h"}


def parse_header(line: str) -> tuple[str, list[str]]:
    """The delimiter and the columns of a header line."""
    line = line.lstrip("﻿").rstrip("\r\n")
    delimiter = max((",", ";", "\t", "|"), key=line.count)
    return delimiter, [c.strip().strip('"') for c in line.split(delimiter)]


def map_columns(columns: list[str], mapping: dict[str, str] | None = None) -> dict[str, tuple[int, str | None]]:
    """Canonical name to (position, unit) by synonym; the first match of a channel counts."""
    given = {normalise_header(k): v for k, v in (mapping or {}).items()}
    found: dict[str, tuple[int, str | None]] = {}
    for i, raw in enumerate(columns):
        name = normalise_header(raw)
        unit = re.search(r"[\[(](.*?)[\])]|/ (\S+)$", name)
        word = re.sub(r"\s*(?:[\[(].*?[\])]|/ \S+$)\s*", "", name).strip()
        target = given.get(name) or next((c for c, words in SYNONYMS.items() if name in words or word in words), None)
        if target and target not in found:
            u = (unit[1] or unit[2] or "") if unit else ""
            found[target] = (i, UNIT_WORDS.get(u.replace(" ", "")))
    return found


def signature(found: dict[str, tuple[int, str | None]]) -> str:
    """Sorted sensors of a file, joined by ``+``."""
    return "+".join(sorted(c for c in found if c in CHANNELS))


def sensor_files(folder: str) -> list[str]:
    """CSV files of a folder, without location files and empty ones."""
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.lower().endswith(".csv") and not f.endswith("Locations.csv") and os.path.getsize(os.path.join(folder, f)) > 0)


def _number(c: str, missing: list[str] = MISSING) -> Column:
    text = F.trim(F.col(c))
    return F.when(~text.isin(missing), F.regexp_replace(text, ",", ".").try_cast("double"))


def read_csv_group(spark: SparkSession, paths: list[str], tag_id: str, mapping: dict[str, str] | None = None, timezone: str = "UTC") -> DataFrame:
    """Files of one signature as one record: canonical channels in canonical units, datetime in UTC, and the file."""
    with open(paths[0], encoding="utf-8", errors="replace") as f:
        delimiter, columns = parse_header(f.readline())
    found = map_columns(columns, mapping)
    raw = spark.read.csv(paths, header=True, sep=delimiter, schema=", ".join(f"c{i} string" for i in range(len(columns))), enforceSchema=True)
    if "datetime" in found:
        text = F.trim(F.col(f"c{found['datetime'][0]}"))
        stamp = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm:ss.SSS", "dd.MM.yyyy HH:mm:ss")])
    elif "date" in found and "time" in found:
        text = F.concat_ws(" ", F.trim(F.col(f"c{found['date'][0]}")), F.trim(F.col(f"c{found['time'][0]}")))
        stamp = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("dd.MM.yyyy HH:mm:ss.SSS", "dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")])
    else:
        raise ValueError(f"{paths[0]} has no time")
    values = []
    for c in CHANNELS:
        if c in found:
            i, unit = found[c]
            x = _number(f"c{i}")
            values.append((convert(x, unit) if unit else x).alias(c))
    return raw.select(F.lit(tag_id).alias("ID"), F.to_utc_timestamp(stamp, timezone).alias("datetime"), *values, F.input_file_name().alias("file")).where("datetime is not null")


def assemble(parts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One record of several files: a row stays if no larger file's span (first to last time) covers it; of rows of one
    time the larger file's stays.

    Files per record are few, their spans are one aggregation; each row is joined once with its record's array of
    spans.
    """
    spark = parts.sparkSession
    rank = {f: n for n, (f, _) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0])))}
    ranks = spark.createDataFrame([(os.path.basename(f), n) for f, n in rank.items()] or [("", 0)], "name string, rank int")
    df = parts.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(ranks, "name")
    spans = df.groupBy("ID", "rank").agg(F.min("datetime").alias("a"), F.max("datetime").alias("z")).groupBy("ID").agg(F.collect_list(F.struct("rank", "a", "z")).alias("spans"))
    met = df.join(spans, "ID").where("not exists(spans, s -> s.rank < rank and datetime between s.a and s.z)")
    w = Window.partitionBy("ID", "datetime").orderBy("rank")
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "rank", "spans", "name", "file")


def read_csv_logger(spark: SparkSession, folder: str, tag_id: str, subdirectory: str = "CMD", mapping: dict | None = None, timezone: str = "UTC") -> DataFrame:
    """CSV logger folder: files like the largest are put together; files with other sensors are left out."""
    where = os.path.join(folder, subdirectory) if subdirectory and os.path.isdir(os.path.join(folder, subdirectory)) else folder
    probed = []
    for path in sensor_files(where):
        with open(path, encoding="utf-8", errors="replace") as f:
            columns = parse_header(f.readline())[1]
        found = map_columns(columns, mapping)
        if ("datetime" in found or {"date", "time"} <= set(found)) and signature(found):
            probed.append((path, signature(found), os.path.getsize(path)))
    if not probed:
        raise ValueError(f"no sensor file in {where}")
    main = max(probed, key=lambda p: (p[2], p[0]))
    paths = [p for p, s, _ in probed if s == main[1]]
    return assemble(read_csv_group(spark, paths, tag_id, mapping, timezone), {p: n for p, s, n in probed if s == main[1]})


def logger_rate(header: list[str]) -> float | None:
    """Readings per second of a text log's header (``... msec/point`` or ``... Hz``)."""
    for line in header:
        if m := re.search(r"([\d.]+)\s*msec/point", line):
            return 1000.0 / float(m[1])
        if m := re.search(r"([\d.]+)\s*Hz", line):
            return float(m[1])
    return None


def read_text_log(spark: SparkSession, path: str, names: list[str], rate: float | None = None) -> tuple[DataFrame, float]:
    """Rows of a clock-less text log with their number `i` from 0, and the rate. The header ends with the last line
    that names columns; numbers follow it.

    Spark splits the file; rows are numbered by `zipWithIndex`, which counts per partition and keeps file order.
    """
    head = []
    with open(path, encoding="latin-1") as f:
        for _ in range(200):
            line = f.readline()
            if not line or re.match(r"^\s*-?\d+(\.\d+)?\s*[,\t;]", line):
                break
            head.append(line)
    hz = rate or logger_rate(head)
    if not hz:
        raise ValueError(f"{path}: no rate")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*-?\d+(\.\d+)?\s*([,\t;].*)?$"))
    numbered = lines.rdd.map(lambda r: r[0]).zipWithIndex().toDF("value string, i bigint")
    parts = F.split(F.regexp_replace("value", r"\s+", ""), "[,;]")
    return numbered.select("i", *[F.get(parts, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)]), hz


def step_hold(fast: DataFrame, slow: DataFrame, hz: float, columns: list[str], slow_hz: float = 1.0) -> DataFrame:
    """Slow columns on the fast rows by row number: row i gets the slow row i // round(hz / slow_hz), the last one at most."""
    last = slow.agg(F.max("i").alias("last"))
    s = slow.select(F.col("i").alias("__s"), *columns)
    # `last` is one row by construction.
    met = fast.join(F.broadcast(last)).withColumn("__s", F.least(F.floor(F.col("i") / max(round(hz / slow_hz), 1)), F.col("last")))
    return met.join(s, "__s", "left").drop("__s", "last")


def read_text_logger(spark: SparkSession, acceleration: str, depth: str | None, start: str, tag_id: str, rate: float | None = None) -> DataFrame:
    """A clock-less logger: times are made of start, row number and rate; slow depth and temperature are held."""
    fast, hz = read_text_log(spark, acceleration, ["ax", "ay", "az"], rate)
    if depth:
        slow, _ = read_text_log(spark, depth, ["depth", "temp"], 1.0)
        fast = step_hold(fast, slow, hz, ["depth", "temp"])
    t = F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("i") * (1e6 / hz))).cast("bigint"))
    return fast.select(F.lit(tag_id).alias("ID"), t.alias("datetime"), *[c for c in ("ax", "ay", "az", "depth", "temp") if c in fast.columns])


def read_locations(spark: SparkSession, path: str, tag_id: str) -> DataFrame:
    """Satellite fixes ``ID, datetime, type, lon, lat, quality``: without time none, one per time, no ``User`` types."""
    raw = spark.read.csv(path, header=True)
    t = F.coalesce(F.try_to_timestamp("Date", F.lit("HH:mm:ss dd-MMM-yyyy")), F.try_to_timestamp("Date", F.lit("HH:mm:ss.SSS dd-MMM-yyyy")))
    df = raw.select(F.lit(tag_id).alias("ID"), t.alias("datetime"), F.col("Type").alias("type"), _number("Longitude").alias("lon"), _number("Latitude").alias("lat"), F.col("Quality").alias("quality")).where("datetime is not null and type <> 'User'")
    w = Window.partitionBy("ID", "datetime").orderBy("type", "lon", "lat")
    return df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def transitions(rows: DataFrame, state: str) -> DataFrame:
    """Only the rows at which a state changes (and each record's first)."""
    w = Window.partitionBy("ID").orderBy("datetime")
    return rows.where(F.col(state).isNotNull()).withColumn("__p", F.lag(state).over(w)).where(~F.col("__p").eqNullSafe(F.col(state))).drop("__p")


def intervals_of(changes: DataFrame, state: str) -> DataFrame:
    """Intervals ``ID, start, end`` in which a state given by its changes is true; the last one stays open (NULL)."""
    w = Window.partitionBy("ID").orderBy("datetime")
    return changes.withColumn("end", F.lead("datetime").over(w)).where(F.col(state)).select("ID", F.col("datetime").alias("start"), "end")


def read_archive(spark: SparkSession, path: str, tag_id: str) -> tuple[DataFrame, DataFrame]:
    """A satellite tag's archive: depth rows (for clock alignment), and the changes of its dry sensor."""
    raw = spark.read.csv(path, header=True)
    t = F.try_to_timestamp("Time", F.lit("HH:mm:ss dd-MMM-yyyy"))
    df = raw.select(F.lit(tag_id).alias("ID"), t.alias("datetime"), *[_number(c).alias(n) for c, n in (("Depth", "depth"), ("Dry", "dry")) if c in raw.columns]).where("datetime is not null")
    dry = transitions(df.withColumn("dry", F.col("dry") > 0), "dry").select("ID", "datetime", "dry") if "dry" in df.columns else df.select("ID", "datetime").limit(0)
    return df.select("ID", "datetime", *(["depth"] if "depth" in df.columns else [])), dry


def read_sidecar(path: str) -> dict:
    """Sections and keys of an INI-like text, or the sample rate of a JSON file. For the record only, never applied."""
    with open(path, encoding="latin-1") as f:
        text = f.read()
    if path.endswith(".json"):
        m = re.search(r'"sampleRate"\s*:\s*"?([\d.]+)', text)
        return {"sampleRate": float(m[1])} if m else {}
    out: dict = {}
    section = out
    for line in text.splitlines():
        line = line.strip()
        if m := re.match(r"\[(.+)\]$", line):
            section = out.setdefault(m[1].strip().lower(), {})
        elif "=" in line:
            key, value = (p.strip() for p in line.split("=", 1))
            numbers = re.fullmatch(r"\s*-?[\d.]+(?:\s*[,;]\s*-?[\d.]+)*\s*", value)
            section[key.lower()] = [float(v) for v in re.split(r"[,;]", value)] if numbers and re.search(r"[,;]", value) else value
    return out


def video_inventory(spark: SparkSession, pattern: str, tag_id: str | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Video files as intervals: start from the file's name, end from a table of durations (``video, duration``)."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    ident = F.lit(tag_id) if tag_id else F.element_at(F.split("path", "/"), -2)
    out = files.select(ident.alias("ID"), name.alias("video"), filename_time(name).alias("start"), F.col("path").alias("file"), F.lit("filename").alias("timestamp_source"))
    if durations is None:
        return out.withColumn("duration", F.lit(None).cast("double")).withColumn("end", F.lit(None).cast("timestamp"))
    met = out.join(durations.select("video", "duration"), "video", "left")
    return met.withColumn("end", F.timestamp_micros((F.unix_micros("start") + F.col("duration") * 1e6).cast("bigint")))


def _has_csv(folder: str) -> bool:
    return any(f.lower().endswith(".csv") for _, _, fs in os.walk(folder) for f in fs)


def _has_log(folder: str) -> bool:
    return any(f.endswith("_A.txt") for f in os.listdir(folder))


#: Name to (whether a folder has such data, reader of (spark, folder, id)).
READERS: dict[str, tuple[Callable[[str], bool], Callable[[SparkSession, str, str], DataFrame]]] = {"csv": (_has_csv, read_csv_logger)}


def register(name: str, detect: Callable[[str], bool], reader: Callable[[SparkSession, str, str], DataFrame]) -> None:
    READERS[name] = (detect, reader)


register("text", _has_log, lambda spark, folder, tag_id: read_text_logger(spark, *_logger_paths(folder), tag_id))


def _logger_paths(folder: str) -> tuple[str, str | None, str]:
    files = os.listdir(folder)
    a = next(f for f in files if f.endswith("_A.txt"))
    d = next((f for f in files if f.endswith("_DT.txt")), None)
    with open(os.path.join(folder, "start.json"), encoding="utf-8") as f:
        start = json.load(f)["start"]
    return os.path.join(folder, a), os.path.join(folder, d) if d else None, start


def detect_format(folder: str) -> str:
    """The one reader whose test a folder passes; an error if there is none or more than one."""
    fits = [n for n, (test, _) in READERS.items() if test(folder)]
    if len(fits) != 1:
        raise ValueError(f"{folder}: {'no reader fits' if not fits else f'several readers fit: {fits}'}")
    return fits[0]


def import_folders(spark: SparkSession, folders: dict[str, str], reader: str = "csv", required: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """The fleet of all readable folders (ID to folder), and why others were skipped; an error if none is readable."""
    parts, skipped = [], {}
    for tag_id, folder in folders.items():
        try:
            name = detect_format(folder) if reader == "auto" else reader
            part = READERS[name][1](spark, folder, tag_id)
            missing = [c for c in required if c not in part.columns]
            if missing:
                raise ValueError(f"channels are missing: {missing}")
            parts.append(part)
        except (ValueError, OSError, StopIteration) as e:
            skipped[tag_id] = str(e)
    if not parts:
        raise ValueError(f"no folder could be read: {skipped}")
    return fleet(*parts), skipped
