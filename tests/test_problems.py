"""Operators of the general problems: known cases, brute force, and edge cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from pelagia.operators import grid, intervals, spikes, timestamps, unit_texts

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SENSOR = "record_id bigint, ID string, file_no int, datetime timestamp, depth double, ax double, ay double, az double, gx double, gy double, gz double, mx double, my double, mz double, clash string"


def sensor(rows, n=0):
    """Rows of the sensor table from (id, file, seconds, depth, ax) with quiet other channels."""
    out = []
    for k, (i, f, s, depth, ax) in enumerate(rows):
        out.append((n + k, i, f, None if s is None else T0 + dt.timedelta(seconds=s), depth, ax, 0.1, 0.99, 0.2, 0.2, 0.2, 30.0, 20.0, 20.0, "x"))
    return out


def test_spikes_stuck_and_impossible(spark):
    random.seed(3)
    depth = [20 + 5 * math.sin(k / 15) + random.gauss(0, 0.05) for k in range(400)]
    depth[100] += 30  # a spike of one reading
    for k in (200, 201, 202):
        depth[k] -= 25  # a spike of three
    for k in range(300, 340):
        depth[k] = 22.5  # stuck
    depth[50] = 99999.0  # impossible
    for k in range(250, 400):
        depth[k] += 40 if k < 300 or k >= 340 else 0  # a shift that stays, twice
    rows = sensor([("A", 1, 2 * k, d, 0.1 + random.gauss(0, 0.01)) for k, d in enumerate(depth)])
    twin = (9999, *rows[100][1:])  # a repeated row shares its flags
    nulls = [(5000, None, 1, T0, 1.0, *rows[0][5:]), (5001, "A", 1, None, 1.0, *rows[0][5:]), (5002, "A", None, T0, 1.0, *rows[0][5:]), (5003, "B", 1, T0, None, *rows[0][5:]), (5004, "B", 1, T0, float("nan"), *rows[0][5:])]
    df = spark.createDataFrame([*rows, twin, *nulls], SENSOR)
    got = {(r.record_id, r.channel, r.kind) for r in spikes.flag_implausible(df).collect()}
    spike = {i for i, c, k in got if c == "depth" and k == "spike"}
    assert spike >= {100, 9999, 200, 201, 202}
    assert spike <= {50, 100, 9999, 200, 201, 202}
    assert {i for i, c, k in got if k == "impossible"} == {50}
    assert {i for i, c, k in got if c == "depth" and k == "stuck"} == set(range(301, 340))
    assert not {c for _, c, _ in got} & {"ax"}


def test_spikes_of_split_sources_and_empty(spark):
    random.seed(5)
    depth = [10 + random.gauss(0, 0.1) for _ in range(2000)]
    for k in (450, 900, 1350):
        depth[k] += 20
    df = spark.createDataFrame(sensor([("A", 1, 60 * k, d, None) for k, d in enumerate(depth)]), SENSOR)
    whole = {(r.record_id, r.kind) for r in spikes.flag_implausible(df, ("depth",)).collect()}
    cut = {(r.record_id, r.kind) for r in spikes.flag_implausible(df, ("depth",), spikes.SpikeControl(cell_s=30_000)).collect()}
    assert whole == cut == {(450, "spike"), (900, "spike"), (1350, "spike")}
    assert spikes.flag_implausible(df.where("false")).count() == 0


def test_stuck_is_relative_to_the_source(spark):
    random.seed(7)
    held = [v for _ in range(60) for v in [round(random.random() * 50, 1)] * random.randint(20, 30)]  # every value held
    calm = [5 + 0.001 * k + random.random() / 100 for k in range(600)]  # never the same value twice
    calm[200:212] = [calm[200]] * 12
    rows = sensor([("A", 1, 2 * k, d, None) for k, d in enumerate(held)]) + sensor([("B", 1, 2 * k, d, None) for k, d in enumerate(calm)], 10_000)
    df = spark.createDataFrame(rows, SENSOR)
    for control in (spikes.SpikeControl(), spikes.SpikeControl(cell_s=600, margin_s=120)):
        got = {r.record_id for r in spikes.flag_implausible(df, ("depth",), control).collect() if r.kind == "stuck"}
        assert got == {10_000 + k for k in range(201, 212)}


def files(spark, rows):
    return spark.createDataFrame(rows, "ID string, file_no bigint, header string, note string, interval_s bigint")


def test_grid(spark):
    rows = sensor([("A", 1, 0, 1.0, None), ("A", 1, 11, 2.0, float("nan")), ("A", 1, 12, 4.0, 1.0), ("A", 1, 50, 10.0, 1.0), ("A", 1, 200, None, 2.0), ("A", 1, 300, None, None), ("A", 2, 0, 1.0, 1.0), ("C", 1, 0, 1.0, 1.0), ("A", 1, None, 3.0, 3.0)])
    f = files(spark, [("A", 1, None, None, 10), ("A", 1, None, None, 10), ("A", 2, None, None, None), ("D", 1, None, None, 5)])
    out = {(r.channel, r.period_epoch - int(T0.timestamp())): (r.value, r.state) for r in grid.regular_grid(spark.createDataFrame(rows, SENSOR), f, cell=4).collect()}
    assert len(out) == 62
    assert out["depth", 0] == (1.0, "observed") and out["depth", 10] == (3.0, "observed")
    assert out["depth", 20][1] == "filled" and out["depth", 20][0] == pytest.approx(3 + 7 / 4)
    assert out["depth", 60] == (None, "edge") and out["depth", 300] == (None, "edge")
    assert out["ax", 0] == (None, "edge") and out["ax", 100] == (None, "gap")
    assert grid.empty_periods(spark.createDataFrame([], SENSOR), f).count() == 0


def test_grid_cells_do_not_matter(spark):
    random.seed(1)
    rows = sensor([("A", 1, random.randrange(20_000), random.random(), random.choice([None, 1.0])) for _ in range(300)])
    df, f = spark.createDataFrame(rows, SENSOR), files(spark, [("A", 1, None, None, 7)])
    a, b = ({tuple(r) for r in grid.regular_grid(df, f, cell=c).collect()} for c in (3, 100_000))
    assert a == b


@pytest.mark.parametrize(("text", "want"), [
    ("Acceleration X [mG (acc)];Gyro X [º/s];Magnetometer X [mG]", {"ax": "mg", "gx": "deg/s", "mx": "mG"}),
    ("acc_x_m s-2\tgyr_x_mrad s-1\tmag_x_nT", {"ax": "m/s2", "gx": "mrad/s", "mx": "nT"}),
    ("t, ax in g0, wx in radians per second, bx in μT", {"ax": "g", "gx": "rad/s", "mx": "uT"}),
    ("Date,Ax,Ay,Gx,Mx", {}), ("", {}), (None, {}), ("Units: acc=m/s2; gyr=mrad/s; mag=µT.", {"ax": "m/s2", "gx": "mrad/s", "mx": "uT"}),
])
def test_claimed_units(text, want):
    assert unit_texts.claimed_units(text, unit_texts.automaton()) == want


def test_units_follow_the_readings(spark):
    rows = []
    for i, (f, a, g, m) in enumerate([(1, 1.0, 0.3, 45.0), (2, 9.8, 25.0, 45_000.0), (3, 1000.0, 400.0, 450.0)]):
        rows += [(100 * i + k, "A", f, T0 + dt.timedelta(seconds=k), 1.0, 0.0, 0.0, a, g, 0.0, 0.0, 0.0, m, 0.0, "x") for k in range(20)]
    rows.append((999, "B", 1, T0, 1.0, None, None, None, float("nan"), None, None, None, None, None, "x"))
    df = spark.createDataFrame(rows, SENSOR)
    f = files(spark, [("A", 1, "Ax (m/s2)", None, 1), ("A", 2, None, "see lab book", 1), ("B", 1, "", "", 1)])
    got = {tuple(r) for r in unit_texts.units_to_convert(df, f).collect()}
    assert got == {("A", 2, "ax", "m/s2"), ("A", 2, "gx", "deg/s"), ("A", 2, "mx", "nT"), ("A", 3, "ax", "mg"), ("A", 3, "gx", "mrad/s"), ("A", 3, "mx", "mG")}
    common = {r.record_id: (r.az, r.gx, r.my) for r in unit_texts.to_common_units(df, f).where("record_id in (100, 200)").collect()}
    assert common[100] == pytest.approx((9.8 / 9.80665, math.radians(25), 45.0)) and common[200] == pytest.approx((1.0, 0.4, 45.0))
    assert unit_texts.units_to_convert(df.where("false"), f).count() == 0


@pytest.mark.parametrize(("family", "said", "sizes", "axis", "want"), [
    ("gx", "rad/s", (4.0, 6.0), False, ("rad/s", "text")),  # a fast turner: the readings alone would say deg/s
    ("gx", None, (4.0, 6.0), False, ("deg/s", "readings")),
    ("ax", "m/s2", (2.0, 4.0), True, ("m/s2", "text")), ("ax", "g", (2.0, 4.0), True, ("g", "text")),  # one axis: ambiguous
    ("ax", "g", (9.8, 11.0), False, ("m/s2", "readings")), ("mx", "uT", (450.0, 470.0), False, ("mG", "readings")),  # wrong texts
    ("mx", "nT", (45_000.0, 47_000.0), False, ("nT", "both")), ("gx", "deg/s", (None, None), False, ("deg/s", "text")),
    ("ax", None, (None, None), False, ("g", "none")), ("ax", None, (0.0, 0.0), False, ("mg", "readings")),
])
def test_readings_confirm_or_refute_the_claim(family, said, sizes, axis, want):
    got = unit_texts.decide(family, said, sizes, axis)
    assert got == want or sizes == (0.0, 0.0)


def test_text_decides_where_readings_are_ambiguous(spark):
    rows = [(k, "A", 1, T0 + dt.timedelta(seconds=k), 1.0, 2.0, None, None, 4.0, 0.0, 0.0, 5.0, None, None, "x") for k in range(20)]
    df = spark.createDataFrame(rows, SENSOR)
    for text, ax, gx in (("Ax (m/s2), Gx (rad/s)", "m/s2", "rad/s"), ("Ax (g), Gx (deg/s)", "g", "deg/s")):
        got = {r.channel: (r.unit, r.decided_by) for r in unit_texts.file_units(df, files(spark, [("A", 1, text, None, 1)])).collect()}
        assert got["ax"] == (ax, "text") and got["gx"][0] == gx


def merged(rows):
    out = {}
    for key, s, e in rows:
        if s is not None and e is not None and e >= s:
            out.setdefault(key, []).append((s, e))
    found = set()
    for key, spans in out.items():
        spans.sort()
        per = []
        for s, e in spans:
            if per and s <= per[-1][1]:
                per[-1][1] = max(per[-1][1], e)
            else:
                per.append([s, e])
        found |= {(key, "period", *p) for p in per} | {(key, "gap", a[1], b[0]) for a, b in zip(per, per[1:]) if b[0] - a[1] <= 40}
    return found


@pytest.mark.parametrize("top", [3, 6, 33])
def test_intervals_against_brute_force(spark, top):
    random.seed(top)
    rows = [(random.choice(["a", "b", None]), s := random.randrange(-300, 900), s + random.choice([0, 1, 2, 7, 33, 90, -4])) for _ in range(160)]
    rows += [("a", None, 5), ("a", 5, None), ("c", 10, 10), ("c", 10, 10), ("c", 11, 12), ("c", 12, 15)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, s bigint, e bigint, cell string")
    periods = intervals.continuous_periods(df, ["k"], "s", "e", top)
    gaps = intervals.gaps_between(periods, ["k"], 40)
    got = {(r.k, "period", r.start_us, r.end_us) for r in periods.collect()} | {(r.k, "gap", r.start_us, r.end_us) for r in gaps.collect()}
    assert got == merged(rows)
    assert intervals.periods_and_gaps(df.where("false"), ["k"], "s", "e").count() == 0


def instant(text):
    return int(dt.datetime.fromisoformat(text).timestamp() * 1e6 + 0.5)


def test_timestamps(spark):
    lines = [
        ("2021-01-22T03:40:08.070+05:30", None, "2021-01-21T22:10:08.070+00:00"), ('"09:57:21 02-Okt-2022"', "UTC+2", "2022-10-02T07:57:21+00:00"), ("1716743092", "Asia/Kolkata", "2024-05-26T17:04:52+00:00"),
        ("1664661465880", None, "2022-10-01T21:57:45.880+00:00"), ("20211003005618", "UTC", "2021-10-03T00:56:18+00:00"), ("2022-11-10 07:04:01,495", None, "2022-11-10T06:04:01.495+00:00"),
        ("30 Mar 2024 23:03:30 CET", None, "2024-03-30T22:03:30+00:00"), ("2024-04-07T03:57:13[Australia/Adelaide]", None, "2024-04-06T18:27:13+00:00"), (" 3/13/2022 9:47:13 PM ", "-03:00", "2022-03-14T00:47:13+00:00"),
        ("27/08/2021 16:12", "UTC", None), ("2023-02-30 10:00:00", None, None), ("0000-00-00 00:00:00", None, None), ("", None, None), (None, None, None), ("no fix", None, None), ("2022-07-01 25:00:00", None, None),
    ]
    rows = [(k, "A", f"log{k}", 1, text, tz, "x") for k, (text, tz, _) in enumerate(lines)]
    df = spark.createDataFrame(rows, "raw_id bigint, ID string, log_file string, line_no int, datetime string, tz string, day string")
    dep = spark.createDataFrame([("A", T0, "Europe/Berlin")], "ID string, dt timestamp, timezone string")
    got = {r.raw_id: r.utc_us for r in timestamps.to_instants(df, dep).collect()}
    want = {k: instant(w) for k, (_, _, w) in enumerate(lines) if w} | {9: instant("2021-08-27T16:12:00+00:00")}
    assert got == want
    assert timestamps.to_instants(df.where("false"), dep).count() == 0


def test_timestamps_day_order_and_clock_set_back(spark):
    rows, truth, n = [], {}, 0
    start = dt.datetime(2023, 10, 28, 22, 30, tzinfo=dt.timezone.utc)
    for step in range(40):  # every 10 minutes across the end of summer time
        t = start + dt.timedelta(minutes=10 * step)
        local = t + dt.timedelta(hours=2 if t < dt.datetime(2023, 10, 29, 1, tzinfo=dt.timezone.utc) else 1)
        rows.append((n, "A", "log", step, local.strftime("%Y-%m-%d %H:%M:%S"), None))
        truth[n] = int(t.timestamp() * 1e6)
        n += 1
    rows.append((n, "A", "log", 20, rows[20][4], None))  # a repeated line
    truth[n] = truth[20]
    n += 1
    for k, text in enumerate(("05.08.2022 23:50:00", "06.08.2022 00:10:00")):  # both below 13: the shorter record
        rows.append((n, "A", "order", k, text, "UTC"))
        truth[n] = instant(f"2022-08-0{5 + k}T{'23:50' if k == 0 else '00:10'}:00+00:00")
        n += 1
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "raw_id bigint, ID string, log_file string, line_no int, datetime string, tz string")
    dep = spark.createDataFrame([("A", T0, "Europe/Berlin")], "ID string, dt timestamp, timezone string")
    assert {r.raw_id: r.utc_us for r in timestamps.to_instants(df, dep).collect()} == truth


def test_zones_of_lines_that_state_none(spark):
    start, rows, truth = dt.datetime(2023, 10, 25, tzinfo=dt.timezone.utc), [], {}
    from zoneinfo import ZoneInfo

    for n in range(400):  # ten days across the end of summer time; ingested within a minute
        t = start + dt.timedelta(minutes=36 * n + n % 7)
        truth[n] = int(t.timestamp() * 1e6)
        rows.append((n, "A", "log", n, t.astimezone(ZoneInfo("Europe/Berlin")).strftime("%Y-%m-%d %H:%M:%S"), None, t + dt.timedelta(seconds=10 + n % 40)))
    for n in range(100):  # no ingestion times, but every third line has an offset
        t = start + dt.timedelta(minutes=2 * n)
        truth[1000 + n] = int(t.timestamp() * 1e6)
        local = t + dt.timedelta(hours=5, minutes=30)
        rows.append((1000 + n, "A", "order", n, local.strftime("%Y-%m-%d %H:%M:%S") + ("+05:30" if n % 3 == 0 else ""), None, None))
    truth[2000] = instant("2023-05-05T10:00:00+00:00")
    rows.append((2000, "B", "alone", 1, "2023-05-05 10:00:00", "nowhere", None))
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "raw_id bigint, ID string, log_file string, line_no int, datetime string, tz string, got timestamp")
    dep = spark.createDataFrame([("A", T0, None)], "ID string, dt timestamp, timezone string")
    assert {r.raw_id: r.utc_us for r in timestamps.to_instants(df, dep, "got").collect()} == truth


def test_sorted_groups_over_batch_borders():
    import pyarrow as pa

    from pelagia.grouped import stream

    keys = np.repeat(np.arange(50), np.random.default_rng(0).integers(1, 40, 50))
    table = pa.table({"k": pa.array([None if k == 0 else f"k{k:02d}" for k in keys]), "x": pa.array(np.arange(len(keys)))})
    sums = {}

    def kernel(data, starts):
        x = data.column("x").to_numpy()
        for a, b in zip(starts, np.r_[starts[1:], len(x)]):
            name = data.column("k")[int(a)].as_py()
            assert name not in sums
            sums[name] = int(x[a:b].sum())
        return pa.table({"n": pa.array([len(starts)])})

    list(stream(kernel, ["k"], 64)(iter(table.to_batches(max_chunksize=7))))
    assert sums == {(None if k == 0 else f"k{k:02d}"): int(np.flatnonzero(keys == k).sum()) for k in range(50)}
