"""Steps of the pivot that have a known truth: the paddle's line, the zero offset, history, controls."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import features, process, quality, regularize, tag

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
IMU = "ID string, datetime timestamp, ax double, ay double, az double, gx double, gy double, gz double, mx double, my double, mz double, depth double, temp double"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def imu(spark, ident="A", n=4000, hz=100.0, paddle=0.0, paddle_hz=10.0, depth=lambda s: 10.0):
    random.seed(1)
    rows = []
    for k in range(n):
        s = k / hz
        line = paddle * math.sin(2 * math.pi * paddle_hz * s)
        rows.append((ident, at(s), 0.05 * math.sin(2 * math.pi * s), 0.1 * math.sin(2 * math.pi * 0.9 * s), 0.99, 0.0, 0.0, 0.1, 20.0 + random.gauss(0, 0.05), 10.0 + random.gauss(0, 0.05), 40.0 + line + random.gauss(0, 0.05), float(depth(s)), 15.0))
    return spark.createDataFrame(rows, IMU)


def test_paddle_line_is_found_and_averaged_away(spark):
    df = imu(spark, paddle=200.0).unionByName(imu(spark, "B"))
    state = process.paddle_state(df)
    found = {r.ID: r for r in state.collect()}
    assert found["A"].present and found["A"].freq == pytest.approx(10, abs=0.5) and found["A"].window_s == pytest.approx(0.8, abs=0.05) and found["A"].separable
    assert not found["B"].present and found["B"].window_s == 0
    calm = process.calm_field(df, state).groupBy("ID").agg(F.stddev("mz").alias("sd"), F.count("mz").alias("n"))
    sd = {r.ID: r.sd for r in calm.collect()}
    raw = {r.ID: r.sd for r in df.groupBy("ID").agg(F.stddev("mz").alias("sd")).collect()}
    assert sd["A"] < 0.25 * raw["A"] and sd["B"] == pytest.approx(raw["B"])
    issues = quality.paddle_contamination(df).collect()
    assert [(r.ID, r.channel, r.severity) for r in issues] == [("A", "mz", "warning")]
    assert quality.paddle_contamination(df, paddles=spark.createDataFrame([("A",)], "ID string")).count() == 0
    assert quality.paddle_contamination(df.where("false")).count() == 0 and process.paddle_state(df.where("false")).count() == 0


def test_spectra_do_not_depend_on_cells_where_they_are_long(spark):
    df = imu(spark, paddle=5.0)
    a, b = ({(r.channel, round(r.freq, 3)): r.power for r in process.power_spectra(df, ["mz"], c).collect()} for c in (5, 1800))
    top = max(a, key=a.get), max(b, key=b.get)
    assert top[0] == top[1] and a[top[0]] == pytest.approx(b[top[1]], rel=0.2)


def test_paddle_speed(spark):
    df = imu(spark, paddle=50.0).unionByName(imu(spark, "B", paddle=50.0)).unionByName(imu(spark, "C", n=400, hz=10.0, paddle=50.0, paddle_hz=2.0)).unionByName(imu(spark, "D").withColumn("mz", F.lit(4.0)))
    slopes = spark.createDataFrame([("A", 0.05), ("C", 0.05), ("D", 0.05)], "ID string, slope double")
    got = {r.ID: r.v for r in process.paddle_speed(df, slopes).groupBy("ID").agg(F.percentile("paddle_speed", 0.5).alias("v")).collect()}
    assert got["A"] == pytest.approx(0.5, rel=0.05) and got["B"] is got["C"] is got["D"] is None
    kept = process.paddle_speed(df.where("ID = 'A'").withColumn("paddle_speed", F.rand(3)), slopes)
    assert kept.agg(F.max("paddle_speed")).first()[0] < 1 and kept.where("paddle_freq is not null").count() == 0


def test_pivot_takes_off_the_zero_offset_and_keeps_history(spark):
    surface = lambda s: 3.0 if s % 100 < 20 else 3.0 + 10 * math.sin(math.pi * (s % 100 - 20) / 80)
    df = imu(spark, n=600, hz=1.0, depth=surface)
    dry = spark.createDataFrame([("A", at(100 * k), at(100 * k + 19)) for k in range(6)], "ID string, start timestamp, end timestamp")
    out, history = process.pivot(df, dry=dry, history=tag.empty_history(spark))
    by = {r.datetime: r for r in out.collect()}
    top = [r.depth for r in by.values()]
    assert min(top) == pytest.approx(0, abs=0.05) and max(top) == pytest.approx(10, abs=0.1)
    assert {(r.step, r.key) for r in tag.flatten_history(history).collect()} >= {("pivot", "static_s"), ("pivot", "depth_drift")}
    plain = process.pivot(df)
    assert plain.agg(F.min("depth")).first()[0] == pytest.approx(3.0)


@pytest.mark.parametrize(("field", "value", "column"), [("static_s", 9.0, "vedba"), ("dba_s", 30.0, "vedba"), ("orientation_s", 21.0, "roll"), ("depth_s", 60.0, "vertical_velocity"), ("velocity_s", 31.0, "vertical_velocity")])
def test_each_smoothing_field_changes_the_result(spark, field, value, column):
    df = imu(spark, n=2000, hz=5.0, depth=lambda s: 10 + 5 * math.sin(s / 9))
    a, b = (process.pivot(df, smoothing=s).agg(F.sum(F.abs(column))).first()[0] for s in ({}, {field: value}))
    assert a is not None and b is not None and abs(a - b) > 1e-6


def test_spline_and_unknown_methods(spark):
    rows = [("A", at(k), None if 20 <= k < 24 or k == 50 else math.sin(k / 5)) for k in range(100)]
    df = spark.createDataFrame(rows, "ID string, datetime timestamp, depth double")
    made = {m: {r.datetime: r.depth for r in regularize.regularize(df, ["depth"], 5, m).collect()} for m in ("linear", "spline", "locf")}
    off = {m: max(abs(v - math.sin((t - T0.replace(tzinfo=None)).total_seconds() / 5)) for t, v in d.items()) for m, d in made.items()}
    assert off["spline"] < 0.005 < off["linear"] < off["locf"]
    cells = {r.datetime: r.depth for r in regularize.regularize(df, ["depth"], 5, "spline", spline_cell=16).collect()}
    assert max(abs(cells[t] - v) for t, v in made["spline"].items()) < 1e-4
    with pytest.raises(ValueError):
        regularize.regularize(df, ["depth"], 5, "cubic")


def test_rhythms_of_a_regular_and_a_random_swimmer(spark):
    random.seed(4)
    rows = [("A", at(k), (350 + 20 * math.sin(k / 8)) % 360, 10 + math.cos(2 * math.pi * k / 10)) for k in range(300)] + [("B", at(k), random.uniform(0, 360), random.uniform(0, 20)) for k in range(300)]
    df = spark.createDataFrame(rows, "ID string, datetime timestamp, heading double, depth double")
    got = {r.ID: r for r in features.rhythms(df, 60).groupBy("ID").agg(*[F.avg(c).alias(c) for c in ("heading_autocorr_avg", "oscillation_regularity", "movement_consistency", "depth_change_rate")]).collect()}
    assert got["A"].heading_autocorr_avg > 0.8 and got["A"].oscillation_regularity == pytest.approx(0, abs=1e-6)
    assert got["B"].oscillation_regularity > 0.2 and got["B"].depth_change_rate > got["A"].depth_change_rate
    assert features.rhythms(df.where("false")).count() == 0


def test_every_metric_works_in_tumbling_windows(spark):
    rows = [("A", at(k), float((37 * k) % 360), float(k % 13)) for k in range(120)]
    df = spark.createDataFrame(rows, "ID string, datetime timestamp, heading double, depth double")
    grid = [("depth", m, 30.0) for m in features.LINEAR] + [("heading", m, 30.0) for m in features.CIRCULAR]
    out = features.features(df, grid, aggregate=True)
    assert out.count() == 4 and not [c for c in out.columns if out.where(F.col(c).isNull()).count()]
    slide = features.features(df, [("heading", m, 5.0) for m in ("median", "range")] + [("depth", "mad", 5.0)])
    assert slide.count() == 116 and np.isfinite(slide.agg(F.avg("heading_median_5s")).first()[0])
