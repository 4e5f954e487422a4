"""Operators on records against closed-form signals and small cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia import control
from pelagia.functions import angles, geo, names, rotations, signal, solar, units
from pelagia.operators import aggregates, alignment, dives, features, joins, magnetometer, mapping, process, quality, regularize, tag, tracks, trim, windows
from pelagia.sources import loggers, sinks

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, "ID string, datetime timestamp, " + columns)


def test_rotations():
    every = rotations.proper_rotations()
    assert len(every) == 24 and len({m.tobytes() for m in every}) == 24
    for m in every:
        assert rotations.is_proper(m) and np.array_equal(rotations.compose(rotations.inverse(m), m), np.eye(3, dtype=int))
        back, dropped = rotations.from_rows(rotations.to_rows(m, "mag"), "mag")
        assert np.array_equal(back, m) and not dropped
    assert rotations.from_rows([("ax", "NA")], "accel") == (None, ["ax"])


def test_filters_and_spectra():
    fs, t = 20.0, np.arange(4000) / 20
    x = np.sin(2 * np.pi * 1.0 * t) + 0.5 * np.sin(2 * np.pi * 0.05 * t) + 2
    high = signal.filter_runs(x, fs, 0.3, "high")
    assert np.std(high[200:-200] - np.sin(2 * np.pi * 1.0 * t)[200:-200]) < 0.05
    cut = signal.both_pass_corner(1.0)
    tone = signal.filter_runs(np.sin(2 * np.pi * 1.0 * t), fs, cut, "low")
    assert np.max(np.abs(tone[500:-500])) == pytest.approx(10 ** (-3 / 20), abs=0.02)
    y = x.copy()
    y[100:110] = np.nan
    assert np.isnan(signal.filter_runs(y, fs, 0.3, "high")[100:110]).all()
    f, p = signal.welch(x, fs)
    assert signal.dominant(f, p, 0.5, 3) == pytest.approx(1.0, abs=0.05)
    assert np.median(signal.envelope(np.sin(2 * np.pi * t))[100:-100]) == pytest.approx(1.0, abs=0.01)
    assert signal.acf_frequency(np.sin(2 * np.pi * 0.3 * t) + 0.5 * np.sin(2 * np.pi * 0.6 * t), fs, 0.1, 3)[0] == pytest.approx(0.3, abs=0.02)
    assert np.nanmedian(signal.morlet_ridge(np.sin(2 * np.pi * 0.7 * t), fs, 0.1, 3)[0]) == pytest.approx(0.7, rel=0.02)
    assert signal.thin(np.array([1.0, 3, 2, 5]), np.array([0, 5, 9, 30]), 6).tolist() == [5, 30]
    s = np.array([0.0, 1, np.nan, 9, 16, 25])
    assert signal.spline(s, np.arange(6.0))[2] == pytest.approx(4, abs=0.5)


def test_units_names_and_controls(spark):
    assert units.linear("dbar") == pytest.approx((0.9945, 0)) and units.linear("F", "K")[0] == pytest.approx(5 / 9) and units.linear("g", "K") is None
    with pytest.warns(UserWarning):
        units.convert(F.lit(1.0), "g", "m")
    assert units.expand_tokens(["accel", "depth", "ax"]) == ["ax", "ay", "az", "depth"] and units.families_of(["gx", "temp", "gz"]) == ["gyro", "temp"]
    assert control.Dives.of({"threshold": 3.0}).threshold == 3.0
    with pytest.raises(ValueError):
        control.Dives.of({"nonsense": 1})
    with pytest.raises(ValueError):
        control.Smoothing(static_s=0)
    row = spark.range(1).select(
        F.unix_timestamp(names.filename_time(F.lit("CAM_20240301-010203.mp4"))).alias("a"), F.unix_timestamp(names.filename_time(F.lit("240301_010203.mov"))).alias("b"), names.filename_time(F.lit("clip.mp4")).alias("c"),
        names.picture_time(F.lit("O1 MAR 2O24 1O:61:3S")).alias("d"), names.short_duration(F.lit(-0.2)).alias("e"), names.short_duration(F.lit(3725.0)).alias("f"), angles.wrap180(F.lit(190.0)).alias("g"), angles.wrap360(F.lit(-10.0)).alias("h"),
    ).first()
    assert row.a == row.b == int(dt.datetime(2024, 3, 1, 1, 2, 3, tzinfo=dt.timezone.utc).timestamp()) and row.c is None
    assert (row.d.minute, row.d.second) == (59, 35) and row.e == "0s" and row.f == "1h 02m" and row.g == -170 and row.h == 350


def test_sun_and_earth(spark):
    day = (dt.date(2024, 6, 21) - dt.date(1970, 1, 1)).days
    rise, fall = solar.event(day, -0.1276, 51.5072, 0.833, True), solar.event(day, -0.1276, 51.5072, 0.833, False)
    assert abs(rise - dt.datetime(2024, 6, 21, 3, 43, tzinfo=dt.timezone.utc).timestamp()) < 90
    assert abs(fall - dt.datetime(2024, 6, 21, 20, 21, 30, tzinfo=dt.timezone.utc).timestamp()) < 90
    assert np.isnan(solar.event(day, 20.0, 80.0, 0.833, True))
    df = frame(spark, [("A", dt.datetime(2024, 6, 21, h, tzinfo=dt.timezone.utc), 0.0, 40.0) for h in (0, 3, 12, 21)] + [("A", at(0), None, 1.0)], "lon double, lat double")
    assert [r.phase for r in solar.with_diel_phase(df, phases=4).collect()] == ["night", "dawn", "day", "dusk", None]
    assert geo.geodesic_km([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(111.3195, abs=1e-3)
    assert geo.geodesic_km([5.0], [5.0], [5.0], [5.0])[0] == 0


def test_record_windows(spark):
    rows = [("A", at(k), float(v) if v is not None else None) for k, v in enumerate([1, None, None, 4, None, None, None, None, 9, None])] + [("B", at(0), None)]
    df, w = frame(spark, rows, "x double"), windows.spec()
    got = df.select("ID", "datetime", windows.gap_length(F.col("x"), w).alias("g"), windows.interpolate(F.col("x"), tag.seconds(), w, 3).alias("i"), windows.lookup(F.col("x"), tag.seconds(), w).alias("l")).where("ID = 'A'").orderBy("datetime").collect()
    assert [r.g for r in got] == [0, 2, 2, 0, 4, 4, 4, 4, 0, 1]
    assert [r.i for r in got] == [1, 2, 3, 4, None, None, None, None, 9, None] and [r.l for r in got][4:] == [5, 6, 7, 8, 9, 9]
    flags = frame(spark, [("A", at(k), v) for k, v in enumerate([True, True, True, False, True, True])], "f boolean")
    assert [r.f for r in windows.drop_short_runs(flags, "f", 2).orderBy("datetime").collect()] == [True] * 6
    assert windows.longest_run(flags, "f").first().n == 3
    twice = frame(spark, [("A", at(0), 1.0), ("A", at(0), float("nan")), (None, at(0), 1.0), ("A", None, 1.0)], "x double")
    assert tag.record(twice).count() == 1


def test_history_and_roster(spark):
    ids = spark.createDataFrame([("A",), ("B",)], "ID string")
    h = tag.append_history(tag.empty_history(spark), ids, "trim", {"x": 1})
    h = tag.append_history(h, ids.where("ID = 'A'"), "trim", {"x": 2})
    got = {r.ID: (r.trim["x"], r.flags) for r in tag.latest_steps(h, ["trim", "pivot"]).collect()}
    assert got == {"A": ("2", "trim"), "B": ("1", "trim")}
    with pytest.raises(ValueError):
        tag.build_tag(ids, "A", {"ID": "x", "y": "x"})


def test_joins(spark):
    left = frame(spark, [("A", at(s), s) for s in (-5, 0, 4, 6, 100)] + [("B", at(0), 9)], "n int")
    right = frame(spark, [("A", at(0), 1.0), ("A", at(10), 2.0)], "v double")
    near = {r.n: r.v for r in joins.as_of(left, right, ["v"], tolerance_us=20_000_000).collect()}
    assert near == {-5: 1.0, 0: 1.0, 4: 1.0, 6: 2.0, 100: None, 9: None}
    back = {r.n: r.v for r in joins.as_of(left, right, ["v"], "backward").collect()}
    assert back == {-5: None, 0: 1.0, 4: 1.0, 6: 1.0, 100: 2.0, 9: None}
    with pytest.raises(ValueError):
        joins.as_of(left, right.withColumn("n", F.lit(1)), ["n"])
    spans = spark.createDataFrame([("A", "e", at(0), at(4)), ("A", "e", at(3), at(6)), ("A", "e", at(9), at(8)), ("A", "f", None, at(8))], "ID string, event string, start timestamp, end timestamp")
    flags = {r.n: (r.e, r.f) for r in joins.flag_intervals(left, spans, ["e", "f"]).collect()}
    assert flags == {-5: (0, 0), 0: (1, 0), 4: (1, 0), 6: (1, 0), 100: (0, 0), 9: (0, 0)}
    seconds = spark.range(600).select(F.lit("A").alias("ID"), F.timestamp_micros(F.col("id") * 1_000_000 + int(T0.timestamp() * 1e6)).alias("datetime"))
    video = spark.createDataFrame([("A", at(100), at(200)), ("A", at(400), at(500))], "ID string, start timestamp, end timestamp")
    assert joins.keep_in_intervals(seconds, video).count() == 202


def train_of_dives(spark, flat=False):
    depth = [0.2] * 30 + ([25.0] * 120 + [0.2] * 60) * 6
    return frame(spark, [("A", at(k), 0.2 if flat else d) for k, d in enumerate(depth)] + [("N", at(k), None) for k in range(20)], "depth double")


def test_dives(spark):
    c = {"threshold": 5.0, "band": 2.0, "min_amplitude": 3.0, "min_duration_s": 10.0, "max_gap_s": 60.0, "wiggle": 0.5, "reference": "surface"}
    found, s = dives.detect(train_of_dives(spark), c)
    m = dives.metrics(found, s).collect()
    assert len(m) == 6 and {r.ID for r in m} == {"A"} and all(r.duration_s == 119 and r.max_depth == 25 for r in m)
    assert m[0].complete and [r.inter_dive_s for r in sorted(m, key=lambda r: r.dive_id)][:5] == [61.0] * 5
    none, s = dives.detect(train_of_dives(spark, flat=True), c)
    assert dives.metrics(none, s).count() == 0 and dives.metrics(none, s).columns[:2] == ["ID", "dive_id"]
    assert none.where("dive_id <> 0").count() == 0
    assert dives.cols(np.array([0.0, 9, 5, 8, 7.5, 8, 0]), 2) == [2] and dives.cols(np.arange(9.0), 1) == []
    twin = frame(spark, [("A", at(k), d) for k, d in enumerate([0.0] * 30 + [30.0] * 60 + [12.0] * 5 + [28.0] * 60 + [0.0] * 30)], "depth double")
    split, s = dives.detect(twin, {**c, "prominence": 10.0})
    assert dives.metrics(split, s).count() == 2 and dives.metrics(*dives.detect(twin, c)).count() == 1
    auto, s = dives.detect(train_of_dives(spark), {})
    assert dives.metrics(auto, s).count() == 6


def test_zero_offset(spark):
    rows = [("A", at(k), k / 14400 * 1.5 + (0 if k % 1800 < 120 else 20)) for k in range(0, 14400, 4)]
    dry = spark.createDataFrame([("A", at(k), at(k + 119)) for k in range(0, 14400, 1800)], "ID string, start timestamp, end timestamp")
    out = dives.zero_offset(frame(spark, rows, "depth double"), dry)
    surface = out.where("depth < 10").agg(F.max(F.abs("depth_corrected")).alias("m"), F.max("drift_status").alias("s")).first()
    assert surface.m < 0.02 and surface.s == "applied"


def test_trim(spark):
    depth = [0.0] * 1800 + [20 + 3 * math.sin(k / 40) for k in range(3600)] + [0.0] * 1800
    b = trim.deployment_bounds(frame(spark, [("A", at(k), d, 20.0) for k, d in enumerate(depth)] + [("Z", at(k), 0.1, 20.0) for k in range(500)], "depth double, temp double")).collect()
    assert [r.ID for r in b] == ["A"]
    assert abs(b[0].attach_us / 1e6 - at(1800).timestamp()) < 60 and abs(b[0].pop_us / 1e6 - at(5400).timestamp()) < 60


def test_regularize(spark):
    rows = [("A", at(k if k < 15 else k + 9), float(k if k < 15 else k + 9)) for k in range(30)]
    df = frame(spark, rows, "x double")
    full = regularize.regularize(df, ["x"], max_gap=20).orderBy("datetime").collect()
    assert [r.x for r in full] == [float(k) for k in range(39)] and sum(r.state == "interpolated" for r in full) == 9
    short = regularize.regularize(df, ["x"], max_gap=5)
    assert short.where("state = 'gap'").count() == 9
    r = regularize.report(df, short).first()
    assert r.n_gaps == 1 and r.largest_gap == 9 and r.status == "critical"


def test_quality(spark):
    rows = [("D", at(k), math.sin(k), math.cos(k), 0.5 * math.sin(k / 3), math.sin(k), math.cos(k), 0.5 * math.sin(k / 3), 20.0) for k in range(500)]
    df = frame(spark, rows, "ax double, ay double, az double, gx double, gy double, gz double, temp double")
    got = {(r["check"], r.channel) for r in quality.check_integrity(df).collect()}
    assert {("duplication", "gyro"), ("dead", "temp")} <= got
    assert quality.drop_failed(df, quality.check_integrity(df)).where("gx is not null or temp is not null").count() == 0
    spiky = frame(spark, [("A", at(k), 10 + math.sin(k / 5) + (100 if k == 30 else 0)) for k in range(60)], "depth double")
    assert [r.depth > 100 for r in quality.anomalies(spiky, "depth", {"max_rate": 5.0}).where("anomaly").collect()] == [True]
    table = spark.createDataFrame([("A", "t", "p", at(0), at(100), 0.0, 0.0), ("B", "t", "p", at(50), at(20), 200.0, 0.0), (None, None, None, None, None, None, None)], "ID string, tag string, pkg string, dt timestamp, rec timestamp, lon double, lat double")
    checks = {(r.id, r["check"]) for r in quality.check_metadata(table).collect()}
    assert checks == {("A", "package_overlap"), ("B", "coordinates"), ("B", "recovery_before_deploy"), ("A", "logger_reuse"), ("B", "logger_reuse"), (None, "missing_id"), (None, "missing_deploy")}


def test_magnetometer(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4000, 3))
    v = 50 * v / np.linalg.norm(v, axis=1, keepdims=True) * [1.2, 0.8, 1.0] + [5, -3, 2]
    df = frame(spark, [("A", at(k), *map(float, x)) for k, x in enumerate(v)] + [("F", at(k), 1.0, 2.0, 3.0) for k in range(10)], "mx double, my double, mz double")
    fit = {r.ID: r for r in magnetometer.ellipsoids(df).collect()}
    assert fit["F"].status == "few_points" and (fit["A"].cx, fit["A"].cy, fit["A"].cz) == pytest.approx((5, -3, 2), abs=0.05)
    fixed = process.apply_mag_calibration(df.where("ID = 'A'"), magnetometer.ellipsoids(df).where("status = 'fitted'").drop("n", "status", "radius"))
    assert magnetometer.spread_of_radius(fixed).first().radius_cv < 0.001
    assert magnetometer.coverage(df.where("ID = 'A'"), magnetometer.hard_iron(df).where("cx is not null")).first().coverage > 0.95


def test_orientation_and_pivot(spark):
    rows = [("A", at(k / 10), 5 + math.sin(k / 100), 20.0, 0.0 + 0.2 * math.sin(2 * math.pi * k / 10), 0.0, 1.0, 0.0, 0.0, 0.0, 20.0, 0.0, 40.0) for k in range(3000)]
    df = frame(spark, rows, "depth double, temp double, ax double, ay double, az double, gx double, gy double, gz double, mx double, my double, mz double")
    out = process.pivot(df)
    mid = out.orderBy("datetime").collect()[100]
    assert out.count() == 300 and abs(mid.roll) < 0.5 and min(mid.heading, 360 - mid.heading) < 0.5 and mid.vedba == pytest.approx(0.2 * 2 / math.pi, abs=0.02)
    att = process.attitude(df).where("datetime > '2024-03-01 00:01:00'").agg(F.max(F.abs("pitch")).alias("p"), F.max(F.abs("roll")).alias("r")).first()
    assert att.r < 1 and att.p < 12
    turned = process.apply_axis_mapping(df, spark.createDataFrame([("A", "accel", [0, 1, 0, -1, 0, 0, 0, 0, 1])], "ID string, family string, m array<int>"))
    a, b = df.orderBy("datetime").limit(5).collect()[3], turned.orderBy("datetime").limit(5).collect()[3]
    assert (b.ax, b.ay, b.az) == (a.ay, -a.ax, a.az)
    scored = mapping.propose(mapping.scores(df)).first()
    assert np.array_equal(rotations.proper_rotations()[scored.candidate][2], [0, 0, 1])


def test_smoothing_windows_are_seconds(spark):
    def depth(k):
        return 0.01 * k + 3 * (k % 7 == 0)

    steps = {"A": 0.02, "B": 30.0}
    rows = [(i, at(k * dt), depth(k), 5.0, 1.0) for i, dt in steps.items() for k in range(1200)]
    df = frame(spark, rows, "depth double, pitch double, roll double")
    got = {i: [r.vertical_velocity for r in process.vertical_velocity(df, {"depth_s": 10.0, "velocity_s": 1.0}).where(F.col("ID") == i).orderBy("datetime").collect()] for i in steps}
    z = np.array([depth(k) for k in range(1200)])
    smooth = np.convolve(z, np.ones(500) / 500, "valid")  # 500 rows are 10 s: 249 before, 250 behind
    rate = np.convolve((smooth[2:] - smooth[:-2]) / 0.04, np.ones(50) / 50, "valid")
    assert got["A"][600] == pytest.approx(rate[600 - 249 - 1 - 24], abs=1e-9) and got["A"][0] is None
    assert got["B"][600] == pytest.approx((z[601] - z[599]) / 60) and got["B"][0] == pytest.approx((z[1] - z[0]) / 30)  # 10 s hold one row
    # The offset is the intercept on the velocity averaged over 10 s: what alternates from row to row is no velocity.
    swim = frame(spark, [("A", at(k), 7.0 + 20 * math.sin(k / 60), 0.0, math.sin(k / 60) + 5 * (-1) ** k) for k in range(1200)], "pitch double, roll double, vertical_velocity double")
    assert process.mount_offsets(swim).first().pitch_offset == pytest.approx(7.0, abs=0.3)
    island = frame(spark, [("A", at(k), None if k in (3, 5) else 10.0 + 0.1 * k) for k in range(9)], "depth double")
    assert [r.datetime.second for r in quality.anomalies(island, "depth", {"isolated": 1}).where("anomaly").collect()] == [4]


def test_queries_keep_the_rate_of_the_record(spark, tmp_path):
    from pelagia.plans import domain

    steps = {"A": 1.0, "B": 30.5, "C": 0.1}
    rows = [(k, i, 1, at(k * dt), 0.1 * math.sin(k), 0.0, 1.0, 0.0, 0.0, 0.0, 20.0, float(k % 7), 40.0, float(k % 50), 20.0, 0.0, 0.0) for i, dt in steps.items() for k in range(240)]
    spark.createDataFrame(rows, "record_id bigint, ID string, file_no int, datetime timestamp, ax double, ay double, az double, gx double, gy double, gz double, mx double, my double, mz double, depth double, temp double, pseudo_lon double, pseudo_lat double").write.parquet(f"{tmp_path}/sensor_data.parquet")
    spark.createDataFrame([(i, 1, None, None) for i in steps], "ID string, file_no int, header string, note string").write.parquet(f"{tmp_path}/sensor_files.parquet")
    for out in (domain._moving(spark, str(tmp_path)), domain.k0_pivot(spark, str(tmp_path))):
        seen = out.select("ID", F.unix_micros("datetime").alias("us")).collect()
        assert {i: sum(r.ID == i for r in seen) for i in steps} == {"A": 240, "B": 240, "C": 24}
        assert {r.us for r in seen if r.ID == "B"} == {int((T0.timestamp() + 30.5 * k) * 1e6) for k in range(240)}


def test_tracks(spark):
    fixes = spark.createDataFrame([(k, "A", at(3600 * k), "FastGPS", 5.0 if k == 3 else 0.01 * k, 5.0 if k == 3 else 0.0, "8") for k in range(5)], "pos_id bigint, ID string, datetime timestamp, type string, lon double, lat double, quality string")
    home = spark.createDataFrame([("A", 0.0, 0.0)], "ID string, lon double, lat double")
    screened = {r.pos_id: r.removed for r in tracks.screen(fixes, home, {"max_distance_km": 5000.0}).collect()}
    assert screened == {0: None, 1: None, 2: None, 3: "speed", 4: None}
    far = {r.pos_id: r.removed for r in tracks.screen(fixes, home, {"max_distance_km": 100.0}).collect()}
    assert far[3] == "distance"
    line = frame(spark, [("A", at(60 * k), 0.01 * k, 0.0) for k in range(60)], "lon double, lat double")
    m = tracks.track_metrics(line).first()
    assert m.straightness == pytest.approx(1.0, abs=1e-3) and m.points == 60
    east = frame(spark, [("A", at(k), 90.0, 0.0, 1.0) for k in range(600)], "heading double, pitch double, paddle_speed double")
    seen = spark.createDataFrame([(k, "A", at(k), "FastGPS", math.degrees(k / 6371000.0), 0.0, "8") for k in (150, 300, 450)], "pos_id bigint, ID string, datetime timestamp, type string, lon double, lat double, quality string")
    ended = spark.createDataFrame([("A", 0.0, 0.0, at(599.4), math.degrees(599 / 6371000.0), 0.0)], "ID string, lon double, lat double, popup_datetime timestamp, popup_lon double, popup_lat double")
    cv = tracks.cross_validate(east, ended, seen, {"speed": "paddle"}).collect()
    assert len(cv) == 4 and max(r.error_m for r in cv) < 2  # three fixes and the pop-up
    assert {r.n_anchors_used for r in cv} == {4} and {r.quality for r in cv} == {"FastGPS", "Popup"} and sum(r.interpolated for r in cv) == 3
    for way in ("linear", "error_weighted", "scale_rotate"):  # leaving one out is what a refit without it gives
        bent = east.withColumn("heading", F.col("paddle_speed") * 90 + 8)
        one = {r.datetime: r.error_m for r in tracks.cross_validate(bent, ended, seen, {"speed": "paddle", "correction": way}).collect()}
        refit = tracks.reconstruct(bent, ended, seen.where("pos_id <> 300"), {"speed": "paddle", "correction": way}).where("datetime = '2024-03-01 00:05:00'").first()
        off = math.hypot((refit.pseudo_lon - math.degrees(300 / 6371000.0)), refit.pseudo_lat) * math.radians(1) * 6371000
        assert one[dt.datetime.fromisoformat("2024-03-01T00:05:00")] == pytest.approx(off, abs=1e-3)
    biased = east.withColumn("heading", F.lit(98.0))
    med = {c: np.median([r.error_m for r in tracks.cross_validate(biased, home, seen, {"speed": "paddle", "correction": c}).collect()]) for c in ("none", "linear")}
    assert med["linear"] < med["none"]
    out = tracks.reconstruct(biased, home, seen, {"speed": "paddle", "correction": "linear"}).where("datetime = '2024-03-01 00:05:00'").first()
    assert out.pseudo_lon == pytest.approx(math.degrees(300 / 6371000.0), abs=1e-6) and out.pseudo_error <= 50
    gate = tracks.reconstructable(tracks.reckon(east, home), tracks.anchors(tracks.reckon(east, home), seen.where("false"), popups=tracks._popups(ended))).first()
    assert gate.gate == "pass" and gate.directedness == 1.0
    turned = tracks.reconstruct(biased, home, seen, {"speed": "paddle", "correction": "scale_rotate"}).where("datetime between '2024-03-01 00:02:30' and '2024-03-01 00:07:30'")
    assert turned.agg(F.max(F.abs(F.radians("pseudo_lat")) * 6371000.0)).first()[0] < 0.5  # the bias of heading is turned away
    assert tracks.export_for_ssm(tracks.reconstruct(east, home, seen), 1).count() == 10


def test_speed_calibration_takes_straight_legs(spark):
    # Legs of 200 s: straight ones at 1, 1.5, 2, 2.5 m/s along a pitch of 60 degrees, then a winding one and a short one.
    speed = [1.0, 1.5, 2.0, 2.5, 1.2, 0.2]
    rows = [("A", at(k), 90.0 if (k - 1) // 200 != 4 or k % 2 else 220.0, 60.0, speed[max(k - 1, 0) // 200] * 2) for k in range(1201)]
    track = frame(spark, rows, "heading double, pitch double, vedba double")
    east = np.cumsum([0.0, *(200 * 0.5 * v for v in speed)])
    marks = spark.createDataFrame([("A", at(200 * k), float(east[k]), 0.0, 10.0) for k in range(7)], "ID string, datetime timestamp, a_east double, a_north double, radius_m double")
    fit = tracks.speed_calibration(track, marks).first()
    assert fit.legs == 4 and fit.slope == pytest.approx(0.5, abs=0.01) and fit.intercept == pytest.approx(0, abs=0.02)


def test_features_and_aggregates(spark):
    df = frame(spark, [("A", at(k), 0.7 * k % 360, 20 + 15 * math.sin(k / 60)) for k in range(600)], "heading double, depth double")
    f = features.features(df, [("heading", "mean", 5.0), ("heading", "sd", 5.0), ("heading", "range", 5.0), ("depth", "rate", 5.0)])
    assert f.count() == 596 and f.agg(F.max("heading_range_5s")).first()[0] == pytest.approx(2.8, abs=1e-6)
    with pytest.raises(ValueError):
        features.features(df, [("heading", "entropy", 5.0)])
    assert features.features(df, [("depth", "mean", 60.0)], aggregate=True).count() == 10
    wrap = frame(spark, [("A", at(0), 359.0), ("A", at(1), 1.0)], "h double").groupBy("ID").agg(angles.circular_mean(F.col("h")).alias("m")).first().m
    assert min(wrap, 360 - wrap) < 1e-6
    tad = aggregates.time_at(df, "depth", [0.0, 10.0, 20.0, 50.0])
    assert tad.agg(F.sum("pct")).first()[0] == pytest.approx(100) and tad.agg(F.sum("hours")).first()[0] == pytest.approx(600 / 3600)
    assert aggregates.pretty(0, 10) == [0, 2, 4, 6, 8, 10]
    assert features.top_segments(df, "depth", 2, 60.0).count() == 2
    cal = spark.createDataFrame([(p, y, 1.0 + (0.1 if p == "B" else 0) + 0.02 * (y - 2018), 1.0) for p in "AB" for y in (2018, 2020)], "package_id string, year int, slope double, r_squared double")
    dep = spark.createDataFrame([("d1", "A", 2018), ("d2", "A", 2022), ("d3", "C", 2019)], "ID string, package_id string, year int")
    got = {r.ID: (round(r.slope, 6), r.source, round(r.rate, 6)) for r in aggregates.impute_slopes(cal, dep).collect()}
    assert got == {"d1": (1.0, "measured", 0.02), "d2": (1.08, "tag-model", 0.02), "d3": (1.07, "baseline", 0.02)}


def test_alignment():
    t = np.arange(0, 8000, 2.0)
    x = sum(h * np.exp(-(((t - m) / 300) ** 2)) for h, m in ((50, 1500), (80, 3800), (40, 6000)))
    lag, r, status = alignment.best_lag(t, x, t - 37, x, control.Alignment())
    assert status == "aligned" and lag == 37 and r > 0.99
    assert alignment.best_lag(t, x * 0, t, x, control.Alignment())[2] == "flat"
    assert alignment.best_lag(t[:100], x[:100], t[:100], x[:100], control.Alignment())[2] == "overlap"


def test_sources_and_sinks(spark, tmp_path):
    cmd = tmp_path / "A" / "CMD"
    cmd.mkdir(parents=True)

    def write(name, begin, n):
        (cmd / name).write_text("Date (UTC);Time (UTC);Accelerometer X [m/s²];Depth [m];Temperature (°C)\n" + "".join(f"01.03.2024;{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.000;9.80665;{s};NA\n" for s in range(begin, begin + n)))

    write("one.csv", 0, 100)
    write("two.csv", 80, 60)
    (cmd / "other.csv").write_text("datetime,foo\n1,2\n")
    (cmd / "empty.csv").write_text("")
    (cmd / "x-Locations.csv").write_text("Date,Type,Latitude,Longitude,Quality\n10:00:00 01-Mar-2024,FastGPS,1,2,7\n10:00:00 01-Mar-2024,Argos,1,2,B\n11:00:00 01-Mar-2024,User,1,2,\n,Argos,1,2,B\n")
    out, skipped = loggers.import_folders(spark, {"A": str(tmp_path / "A"), "B": str(tmp_path / "nowhere")})
    assert set(skipped) == {"B"} and out.count() == 140 and out.agg(F.max("ax")).first()[0] == pytest.approx(1.0) and out.where("temp is not null").count() == 0
    assert loggers.read_locations(spark, str(cmd / "x-Locations.csv"), "A").count() == 1
    log = tmp_path / "L"
    log.mkdir()
    (log / "t_A.txt").write_bytes(b"Title\r\n50 msec/point\r\nX ,Y ,Z\r\n" + b"".join(b"%d , 0 , 1 ,\r\n" % k for k in range(45)))
    (log / "t_DT.txt").write_bytes(b"Title\r\nDepth , Temp\r\n" + b"".join(b"%d , 20\r\n" % k for k in range(2)))
    rec = loggers.read_text_logger(spark, str(log / "t_A.txt"), str(log / "t_DT.txt"), "2024-03-01 00:00:00", "L").orderBy("datetime").collect()
    assert len(rec) == 45 and [rec[k].depth for k in (0, 19, 20, 44)] == [0, 0, 1, 1] and rec[1].datetime.microsecond == 50_000 and rec[7].ax == 7
    (tmp_path / "c.txt").write_text("[device]\nname=x\noffsets=1, 2, -3\n")
    (tmp_path / "c.json").write_text('{"sampleRate": "50"}')
    assert loggers.read_sidecar(str(tmp_path / "c.txt")) == {"device": {"name": "x", "offsets": [1.0, 2.0, -3.0]}} and loggers.read_sidecar(str(tmp_path / "c.json")) == {"sampleRate": 50.0}
    (tmp_path / "L2").mkdir()
    with pytest.raises(ValueError):
        loggers.detect_format(str(tmp_path / "L2"))
    path = sinks.save_records(out, str(tmp_path / "saved"), salt=2)
    assert sinks.load_records(spark, path).where("ID = 'A'").count() == 140
    with pytest.raises(ValueError):
        sinks.output(out, None, return_data=False)


def test_streaming(spark, tmp_path):
    from pelagia.streaming import live

    src = str(tmp_path / "in")
    frame(spark, [("A", at(k), float(v)) for k, v in enumerate([0, 6, 3, 1, 3, 6, 6, 3])], "depth double").coalesce(1).write.parquet(src)
    stream = live.read_folder(spark, src, "ID string, datetime timestamp, depth double")
    q = live.hysteresis(stream, "depth", 5.0, 2.0).writeStream.format("memory").queryName("hyst").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.on for r in spark.table("hyst").orderBy("datetime").collect()] == [0, 1, 1, 0, 0, 1, 1, 1]
    assert live.sessions(stream, "1 minute").isStreaming and live.tumbling(stream, "10 seconds", ["depth"]).isStreaming


def test_catalog_is_consistent():
    from pelagia.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100
