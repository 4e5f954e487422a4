"""Positions and tracks: screening, dead reckoning with correction and uncertainty, metrics, validation, export."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.control import FilterLocations, Reckoning, TrackMetrics
from pelagia.functions.geo import RADIUS_KM, bearing, from_local, geodesic_km, haversine_km, to_local
from pelagia.grouped import numbers, over_sorted_groups
from pelagia.operators.tag import seconds
from pelagia.operators.windows import first_per_bin, reverse, spec
from pelagia.runtime import cut

# Error radius in metres by location quality, and by kind of fix.
RADII = {"3": 250.0, "2": 500.0, "1": 1500.0, "0": 3000.0, "A": 5000.0, "B": 10000.0, "Z": 50000.0}
KINDS = {"FastGPS": 50.0, "User": 50.0, "Deploy": 50.0, "Popup": 50.0}


def screen(fixes: DataFrame, deployments: DataFrame, control: FilterLocations | dict | None = None) -> DataFrame:
    """Fixes (with datetime, lon and lat) with `removed`: ``satellites`` (FastGPS with too few), ``distance`` (too far from
    the deployment), ``speed`` (root speed test), or NULL for those that stay. Only removable types are removed."""
    c = FilterLocations.of(control)
    # A deployment without coordinates, or an unknown one, has no distance test.
    home = deployments.where("ID is not null").groupBy("ID").agg(F.min("lon").alias("__lon"), F.min("lat").alias("__lat"))
    whole = fixes.where("ID is not null and datetime is not null and not isnan(lon) and not isnan(lat) and lon is not null and lat is not null").join(home, "ID", "left")
    can = F.col("type").isin(*c.removable)
    few = (F.col("type") == "FastGPS") & (F.col("quality").try_cast("int") < c.min_satellites)
    far = haversine_km(F.col("__lon"), F.col("__lat"), F.col("lon"), F.col("lat")) > c.max_distance_km
    first = whole.withColumn("removed", F.when(can & F.coalesce(few, F.lit(False)), "satellites").when(can & F.coalesce(far, F.lit(False)), "distance")).drop("__lon", "__lat")
    kept = first.where("removed is null")

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = table.column("datetime").cast(pa.int64()).to_numpy() / 1e6
        lon, lat, rid = numbers(table, "lon").astype(float), numbers(table, "lat").astype(float), numbers(table, "pos_id")
        removable = np.isin(np.array(table.column("type").to_pylist(), object), list(c.removable))
        gone = []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(t)].tolist()):
            gone += [int(rid[a + k]) for k in speed_outliers(lon[a:b], lat[a:b], t[a:b], removable[a:b], c)]
        return pa.table({"pos_id": pa.array(gone, pa.int64())})

    fast = over_sorted_groups(kept.select("ID", "datetime", "pos_id", "lon", "lat", "type"), ["ID"], ["datetime", "pos_id"], kernel, "pos_id bigint")
    return first.join(fast.withColumn("__fast", F.lit("speed")), "pos_id", "left").withColumn("removed", F.coalesce("removed", "__fast")).drop("__fast")


def speed_outliers(lon, lat, t, removable, c: FilterLocations) -> list[int]:
    """Positions removed one at a time, the worst first: an inner fix falls if both of its legs are too fast (or
    one, with a sharp turn), an end fix if its leg is."""
    at = list(range(len(t)))
    out: list[int] = []
    for _ in range(c.max_iterations):
        if len(at) < 2:
            break
        k = np.array(at)
        d = geodesic_km(lon[k[:-1]], lat[k[:-1]], lon[k[1:]], lat[k[1:]])
        h = np.maximum(np.diff(t[k]) / 3600, 1e-9)
        v = np.where(np.diff(t[k]) > 0, d / h, np.where(d > 0, np.inf, 0.0))
        into, away = np.r_[np.nan, v], np.r_[v, np.nan]
        both = (into > c.max_speed_kmh) & (away > c.max_speed_kmh)
        if c.spike_angle is not None:
            course = np.degrees(np.arctan2((lon[k[1:]] - lon[k[:-1]]) * np.cos(np.radians(lat[k[:-1]])), lat[k[1:]] - lat[k[:-1]]))
            turn = np.r_[0, np.abs((np.diff(course) + 180) % 360 - 180), 0] if len(k) > 2 else np.zeros(len(k))
            both |= (turn >= c.spike_angle) & ((into > c.max_speed_kmh) | (away > c.max_speed_kmh))
        both[0], both[-1] = v[0] > c.max_speed_kmh, v[-1] > c.max_speed_kmh
        bad = np.flatnonzero(both & removable[k])
        if not len(bad):
            break
        worst = int(bad[np.argmax(np.fmax(into, away)[bad])])
        out.append(at.pop(worst))
    return out


def speed_column(data: DataFrame, control: Reckoning) -> DataFrame:
    """`data` with `speed_dr` (m/s): constant, paddle, vertical speed over the sine of a steep pitch, or linear in
    vedba; what is missing is the constant. Cut to [0, max]; 0 below the rest quantile of vedba."""
    c = control
    have = set(data.columns)
    value = F.lit(None).cast("double")
    if c.speed == "paddle" and "paddle_speed" in have:
        value = F.col("paddle_speed")
    elif c.speed == "depth_rate":
        value = F.when(F.abs("pitch") >= c.min_pitch, F.try_divide(F.abs("vertical_velocity"), F.nullif(F.abs(F.sin(F.radians("pitch"))), F.lit(0.0))))
    elif c.speed == "vedba":
        value = F.col("vedba") * c.vedba_slope + c.vedba_intercept
    out = data.withColumn("speed_dr", F.greatest(F.least(F.coalesce(value, F.lit(c.constant)), F.lit(c.max_speed)), F.lit(0.0)))
    if c.rest_quantile is not None and "vedba" in have:
        rest = data.groupBy("ID").agg(F.percentile("vedba", c.rest_quantile).alias("__rest"))
        out = out.join(rest, "ID", "left").withColumn("speed_dr", F.when(F.col("vedba") < F.col("__rest"), 0.0).otherwise(F.col("speed_dr"))).drop("__rest")
    return out


def reckon(data: DataFrame, deployments: DataFrame, control: Reckoning | dict | None = None) -> DataFrame:
    """`data` with speed_dr and the uncorrected track `east_m`, `north_m`, `dr_lon`, `dr_lat` from the deployment's place,
    and the length of its path so far, `path_m`.

    Time steps that are missing or not positive count as the record's median step; a missing heading or pitch
    adds no movement.
    """
    c = Reckoning.of(control)
    home = deployments.where("ID is not null").groupBy("ID").agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"))
    w = spec()
    df = speed_column(data, c).join(home, "ID")
    df = df.withColumn("__dt", seconds() - F.lag(seconds()).over(w))
    usual = df.groupBy("ID").agg(F.percentile(F.when(F.col("__dt") > 0, F.col("__dt")), 0.5).alias("__u"))
    df = df.join(usual, "ID").withColumn("__dt", F.when(F.row_number().over(w) == 1, 0.0).when(F.col("__dt") > 0, F.col("__dt")).otherwise(F.col("__u")))
    flat = F.col("speed_dr") * F.cos(F.radians("pitch")) * F.col("__dt")
    df = df.withColumn("__e", F.coalesce(flat * F.sin(F.radians("heading")), F.lit(0.0))).withColumn("__n", F.coalesce(flat * F.cos(F.radians("heading")), F.lit(0.0)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("north_m", F.sum("__n").over(upto)).withColumn("dr_lat", F.col("lat0") + F.degrees(F.col("north_m") / (RADIUS_KM * 1000)))
    # Longitude uses the latitude that each step has reached.
    df = df.withColumn("dr_lon", F.col("lon0") + F.sum(F.degrees(F.col("__e") / (RADIUS_KM * 1000 * F.cos(F.radians("dr_lat"))))).over(upto))
    east, north = to_local(F.col("dr_lon"), F.col("dr_lat"), F.col("lon0"), F.col("lat0"))
    df = df.withColumn("east_m", east).withColumn("north_m", north)
    step = F.sqrt((F.col("east_m") - F.lag("east_m").over(w)) ** 2 + (F.col("north_m") - F.lag("north_m").over(w)) ** 2)
    return df.withColumn("__s", F.coalesce(step, F.when(F.col("east_m").isNotNull(), 0.0))).withColumn("path_m", F.sum("__s").over(upto)).drop("__dt", "__u", "__e", "__n", "__s")


def anchors(track: DataFrame, fixes: DataFrame, control: Reckoning | dict | None = None, popups: DataFrame | None = None) -> DataFrame:
    """``ID, datetime, a_east, a_north, radius_m, quality``: the deployment's place at the first row, the place of the
    pop-up (``ID, datetime, lon, lat``) at the row nearest to its time, and the fixes in the record's span. Of several at
    one time deployment goes before pop-up before fix, and of fixes the best. A fix's radius goes by its `type` where
    that tells it, else by its `quality`."""
    c = Reckoning.of(control)
    own = track.groupBy("ID").agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.min("lon0").alias("lon0"), F.min("lat0").alias("lat0"))

    def of(table: dict, x):
        return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)

    kind = F.col("type") if "type" in fixes.columns else F.lit(None).cast("string")
    e, n = to_local(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    inside = fixes.where("lon is not null and lat is not null").join(own, "ID").where(F.col("datetime").between(F.col("first"), F.col("last")))
    seen = inside.select("ID", "datetime", F.lit(3).alias("o"), F.coalesce(of(KINDS, kind), of(RADII, F.col("quality")), F.lit(c.default_radius_m)).alias("r"), e.alias("e"), n.alias("n"), F.when(kind.isin(*KINDS), kind).otherwise(F.col("quality")).alias("q"))
    start = own.select("ID", F.col("first").alias("datetime"), F.lit(1).alias("o"), F.lit(KINDS["Deploy"]).alias("r"), F.lit(0.0).alias("e"), F.lit(0.0).alias("n"), F.lit("Deploy").alias("q"))
    everything = start.unionByName(seen)
    if popups is not None:
        from pelagia.operators.joins import as_of

        at = as_of(popups.where("datetime is not null and lon is not null and lat is not null"), track.select("ID", "datetime", F.col("datetime").alias("__at")), ["__at"]).where("__at is not null")
        up = at.join(own, "ID").select("ID", F.col("__at").alias("datetime"), F.lit(2).alias("o"), F.lit(KINDS["Popup"]).alias("r"), e.alias("e"), n.alias("n"), F.lit("Popup").alias("q"))
        everything = everything.unionByName(up)
    best = everything.groupBy("ID", "datetime").agg(F.min_by(F.struct("e", "n", "r", "q"), F.struct("o", "r", "e", "n")).alias("x"))
    return best.select("ID", "datetime", F.col("x.e").alias("a_east"), F.col("x.n").alias("a_north"), F.col("x.r").alias("radius_m"), F.col("x.q").alias("quality"))


def _at_rows(track: DataFrame, anchor_rows: DataFrame) -> DataFrame:
    """Anchors with the reckoned place and path of the row at or behind their time (else before)."""
    w = Window.partitionBy("ID").orderBy("__t", "__kind")
    ahead = reverse(("ID",), ("__t", "__kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = track.select("ID", F.unix_micros("datetime").alias("__t"), F.lit(1).alias("__kind"), F.struct("east_m", "north_m", "path_m").alias("__p"), F.lit(None).alias("__a"))
    marks = anchor_rows.select("ID", F.unix_micros("datetime").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).alias("__p"), F.struct("a_east", "a_north", "radius_m", "quality").alias("__a"))
    here = F.coalesce(F.last("__p", True).over(ahead), F.last("__p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.unionByName(marks).withColumn("__here", here).where("__kind = 0 and __here is not null").select("ID", F.col("__t").alias("t"), "__here.*", "__a.*")


_LINES = "ID string, t bigint, ce double, cn double, radius double, path double, tight double, tail double, pe double, pn double, ae double, an double"
_HELD = "ID string, t bigint, quality string, radius double, east double, north double, pe double, pn double, gap_h double, interpolated boolean, used bigint"


def _gain(c: Reckoning, seconds_apart, radius):
    if c.correction == "none":
        return 0.0
    if c.correction != "error_weighted":
        return 1.0
    drift2 = (c.drift_rate * seconds_apart) ** 2 + c.diffusion * seconds_apart
    return drift2 / (drift2 + radius**2) if drift2 > 0 else 0.0


def _folded(c: Reckoning, held: bool):
    """Walks over a record's anchors in time order. The offset from the reckoned track is carried from anchor to anchor: at each
    it moves by `gain` of what is left of the distance to the fix."""

    def lines(a: dict[str, np.ndarray]) -> list[tuple]:
        n, ce, cn, out = len(a["t"]), 0.0, 0.0, []
        for k in range(n):
            tight = tail = a["radius_m"][k]
            if k:
                s = (a["t"][k] - a["t"][k - 1]) / 1e6
                g = _gain(c, s, a["radius_m"][k])
                ce += g * (a["a_east"][k] - a["east_m"][k] - ce)
                cn += g * (a["a_north"][k] - a["north_m"][k] - cn)
                from_before = a["radius_m"][k - 1] ** 2 + (c.drift_rate * s) ** 2 + c.diffusion * s
                tight = tail = (1 / (1 / from_before + 1 / a["radius_m"][k] ** 2)) ** 0.5
            out.append((int(a["t"][k]), ce, cn, a["radius_m"][k], a["path_m"][k], tight, tail, a["east_m"][k], a["north_m"][k], a["a_east"][k], a["a_north"][k]))
        return out

    def left_out(a: dict[str, np.ndarray]) -> list[tuple]:
        n, out = len(a["t"]), []
        ce = cn = 0.0
        for k in range(n):
            if a["quality"][k] != "Deploy" and k:
                east, north = a["east_m"][k] + ce, a["north_m"][k] + cn
                if k + 1 < n:  # the leg from the anchor before to the one behind, as if this one were not there
                    s = (a["t"][k + 1] - a["t"][k - 1]) / 1e6
                    whole = a["path_m"][k + 1] - a["path_m"][k - 1]
                    w = (a["path_m"][k] - a["path_m"][k - 1]) / whole if c.weighting == "distance" and whole > 1e-6 else (a["t"][k] - a["t"][k - 1]) / 1e6 / s if s > 0 else 0.0
                    g = _gain(c, s, a["radius_m"][k + 1]) * w
                    de, dn = g * (a["a_east"][k + 1] - a["east_m"][k + 1] - ce), g * (a["a_north"][k + 1] - a["north_m"][k + 1] - cn)
                    east, north = east + de, north + dn
                    if c.correction == "scale_rotate":
                        leg = complex(a["east_m"][k + 1] - a["east_m"][k - 1], a["north_m"][k + 1] - a["north_m"][k - 1])
                        want = complex(a["a_east"][k + 1] - a["a_east"][k - 1], a["a_north"][k + 1] - a["a_north"][k - 1])
                        if abs(leg) > 10 and 0.2 < abs(want / leg) < 5:
                            z = complex(a["a_east"][k - 1], a["a_north"][k - 1]) + want / leg * complex(a["east_m"][k] - a["east_m"][k - 1], a["north_m"][k] - a["north_m"][k - 1])
                            east, north = z.real, z.imag
                others = [abs(a["t"][j] - a["t"][k]) for j in (k - 1, k + 1) if 0 <= j < n]
                out.append((int(a["t"][k]), a["quality"][k], a["radius_m"][k], east, north, a["a_east"][k], a["a_north"][k], min(others) / 3.6e9, k + 1 < n, n - 1))
            if k:
                g = _gain(c, (a["t"][k] - a["t"][k - 1]) / 1e6, a["radius_m"][k])
                ce += g * (a["a_east"][k] - a["east_m"][k] - ce)
                cn += g * (a["a_north"][k] - a["north_m"][k] - cn)
        return out

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        columns = {n: numbers(table, n).astype(float) for n in ("a_east", "a_north", "radius_m", "east_m", "north_m", "path_m")} | {"t": numbers(table, "t"), "quality": np.array(table.column("quality").to_pylist(), object)}
        ids = table.column("ID").take(pa.array(starts)).to_pylist()
        rows = [(ids[k], *r) for k, (a, b) in enumerate(zip(starts.tolist(), np.r_[starts[1:], len(table)].tolist())) for r in (left_out if held else lines)({n: v[a:b] for n, v in columns.items()})]
        types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = [f.split() for f in (_HELD if held else _LINES).split(", ")]
        return pa.table({n: pa.array([r[k] for r in rows], types[t]) for k, (n, t) in enumerate(fields)})

    return kernel


def correct(track: DataFrame, anchor_rows: DataFrame, control: Reckoning | dict | None = None) -> DataFrame:
    """`track` with `pseudo_lon`, `pseudo_lat`, `pseudo_error`: reckoned between anchors, drawn to each of them.

    The offset from the reckoned track is carried from anchor to anchor: at each it takes up what is left of the
    distance to the fix (``linear``: all of it; ``error_weighted``: the part that the reckoning's own uncertainty since
    the last anchor warrants against the fix's radius), and on the way it changes with the distance travelled (or with
    time, by `weighting`). It stays beyond the last anchor. ``scale_rotate`` turns and stretches each leg onto its anchors
    instead. ``none`` leaves the reckoned track. Uncertainty grows from the last anchor and towards the next,
    ``drift^2 = (rate t)^2 + diffusion t``, and both are fused by their inverse variances; behind the last anchor it grows
    from what is left there.
    """
    c = Reckoning.of(control)
    used = anchor_rows.where("quality = 'Deploy'") if c.correction == "none" else anchor_rows
    folded = over_sorted_groups(_at_rows(track, used), ["ID"], ["t"], _folded(c, False), _LINES)
    w = Window.partitionBy("ID").orderBy("__t", "__kind")
    ahead = reverse(("ID",), ("__t", "__kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = track.select("ID", F.unix_micros("datetime").alias("__t"), F.lit(1).alias("__kind"), F.struct(*track.columns).alias("__row"), F.lit(None).alias("__d"))
    marks = folded.select("ID", F.col("t").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).alias("__row"), F.struct(*[c for c in folded.columns if c != "ID"]).alias("__d"))
    a, b = F.last("__d", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last("__d", True).over(ahead)
    res = rows.unionByName(marks).withColumn("__x", a).withColumn("__y", b).where("__kind = 1")
    in_time = F.coalesce(F.try_divide(F.col("__t") - F.col("__x.t"), F.nullif(F.col("__y.t") - F.col("__x.t"), F.lit(0))), F.lit(0.0))
    part = in_time
    if c.weighting == "distance":
        whole = F.col("__y.path") - F.col("__x.path")
        part = F.when(whole > 1e-6, (F.col("__row.path_m") - F.col("__x.path")) / whole).otherwise(in_time)

    def moved(k: str):
        return F.coalesce(F.col(f"__x.{k}"), F.lit(0.0)) + F.coalesce(part * (F.col(f"__y.{k}") - F.col(f"__x.{k}")), F.lit(0.0))

    east, north = F.col("__row.east_m") + moved("ce"), F.col("__row.north_m") + moved("cn")
    if c.correction == "scale_rotate":
        # The leg turned and stretched onto its anchors; legs that hardly lead anywhere stay linear.
        dpe, dpn = F.col("__y.pe") - F.col("__x.pe"), F.col("__y.pn") - F.col("__x.pn")
        dae, dan = F.col("__y.ae") - F.col("__x.ae"), F.col("__y.an") - F.col("__x.an")
        size = dpe * dpe + dpn * dpn
        re, im = F.try_divide(dae * dpe + dan * dpn, F.nullif(size, F.lit(0.0))), F.try_divide(dan * dpe - dae * dpn, F.nullif(size, F.lit(0.0)))
        stretch = F.sqrt(re * re + im * im)
        fits = (size > 100.0) & (stretch > 0.2) & (stretch < 5.0)
        qe, qn = F.col("__row.east_m") - F.col("__x.pe"), F.col("__row.north_m") - F.col("__x.pn")
        east, north = F.when(fits, F.col("__x.ae") + re * qe - im * qn).otherwise(east), F.when(fits, F.col("__x.an") + im * qe + re * qn).otherwise(north)
    lon, lat = from_local(east, north, F.col("__row.lon0"), F.col("__row.lat0"))

    def variance(side: str, sign: int, size: str = "radius"):
        s = sign * (F.col("__t") - F.col(f"{side}.t")) / 1e6
        return F.col(f"{side}.{size}") ** 2 + s * s * c.drift_rate**2 + c.diffusion * s

    va, vb, tail = variance("__x", 1), variance("__y", -1), variance("__x", 1, "tail")
    error = F.sqrt(F.when(va.isNotNull() & vb.isNotNull(), 1 / (1 / va + 1 / vb)).otherwise(F.coalesce(tail, vb)))
    error = F.when(F.col("__t") == F.col("__x.t"), F.least(error, F.col("__x.tight"))).otherwise(error)
    return res.select("__row.*", lon.alias("pseudo_lon"), lat.alias("pseudo_lat"), error.alias("pseudo_error"))


def _popups(deployments: DataFrame) -> DataFrame | None:
    if not {"popup_datetime", "popup_lon", "popup_lat"} <= set(deployments.columns):
        return None
    return deployments.select("ID", F.col("popup_datetime").alias("datetime"), F.col("popup_lon").alias("lon"), F.col("popup_lat").alias("lat"))


def reconstruct(data: DataFrame, deployments: DataFrame, fixes: DataFrame, control: Reckoning | dict | None = None) -> DataFrame:
    """The corrected track. `deployments` may have popup_datetime, popup_lon and popup_lat."""
    track = cut(reckon(data, deployments, control))  # read twice below
    return correct(track, anchors(track, fixes, control, _popups(deployments)), control)


def cross_validate(data: DataFrame, deployments: DataFrame, fixes: DataFrame, control: Reckoning | dict | None = None) -> DataFrame:
    """Leave one anchor out: ``ID, datetime, quality, error_m, gap_h, interpolated, fix_radius_m, n_anchors_used,
    speed_method, vpc_method`` for each fix and pop-up (never the deployment's place).

    The track without an anchor differs from the whole one only behind the anchor before, so its place at the left-out
    time follows from that anchor's carried offset and the anchor behind: the result is that of a refit per anchor.
    """
    c = Reckoning.of(control)
    track = cut(reckon(data, deployments, c))
    marks = _at_rows(track, anchors(track, fixes, c, _popups(deployments)))
    held = over_sorted_groups(marks, ["ID"], ["t"], _folded(c, True), _HELD)
    home = track.groupBy("ID").agg(F.min("lon0").alias("lon0"), F.min("lat0").alias("lat0"))
    met = held.join(home, "ID")
    (x, y), (u, v) = from_local(F.col("east"), F.col("north"), F.col("lon0"), F.col("lat0")), from_local(F.col("pe"), F.col("pn"), F.col("lon0"), F.col("lat0"))
    return met.select("ID", F.timestamp_micros("t").alias("datetime"), "quality", (1000 * haversine_km(x, y, u, v)).alias("error_m"), "gap_h", "interpolated", F.col("radius").alias("fix_radius_m"), F.col("used").alias("n_anchors_used"), F.lit(c.speed).alias("speed_method"), F.lit(c.correction).alias("vpc_method"))


def legs(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """`points` (with both coordinates) with the step from the point before, its bearing and the wrapped turn."""
    w = spec(order=("datetime", "lon", "lat") if lon == "lon" else ("datetime",))
    p = points.where(f"{lon} is not null and {lat} is not null")
    a, b = F.lag(lon).over(w), F.lag(lat).over(w)
    p = p.withColumn("step_km", haversine_km(a, b, F.col(lon), F.col(lat))).withColumn("course", bearing(a, b, F.col(lon), F.col(lat)))
    return p.withColumn("turn", F.pmod(F.col("course") - F.lag("course").over(w) + 180.0, F.lit(360.0)) - 180.0)


def track_metrics(points: DataFrame, lon: str = "lon", lat: str = "lat", control: TrackMetrics | dict | None = None) -> DataFrame:
    """Per ID: points, hours, path and net length (km), straightness, sinuosity and mean absolute turn; tortuosity
    (path over net) averaged over whole hours and days. NULL under the least number of points."""
    c = TrackMetrics.of(control)
    p = legs(points, lon, lat)
    ends = p.groupBy("ID").agg(
        F.count(F.lit(1)).alias("points"), ((F.max(seconds()) - F.min(seconds())) / 3600).alias("hours"), F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("path_km"),
        F.min_by(F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")), "datetime").alias("a"), F.max_by(F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")), "datetime").alias("z"),
        F.stddev_samp(F.radians("turn")).alias("sd"), F.avg("step_km").alias("step"), F.avg(F.abs("turn")).alias("mean_turn"),
    )
    net = haversine_km(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y"))
    out = ends.withColumn("net_km", net)
    for name, us in (("hourly", 3_600_000_000), ("daily", 86_400_000_000)):
        bins = p.groupBy("ID", F.floor(F.unix_micros("datetime") / us).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("step_km").alias("s"), F.min_by(F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")), "datetime").alias("a"), F.max_by(F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")), "datetime").alias("z"), F.min_by("step_km", "datetime").alias("lead_in"))
        inner = F.col("s") - F.coalesce(F.col("lead_in"), F.lit(0.0))
        bins = bins.where(f"n >= {c.min_points}").withColumn("t", F.try_divide(inner, F.nullif(haversine_km(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y")), F.lit(0.0))))
        out = out.join(bins.groupBy("ID").agg(F.avg("t").alias(f"tortuosity_{name}")), "ID", "left")
    enough = F.col("points") >= c.min_points
    return out.select("ID", "points", F.round("hours", 3).alias("hours"), F.round("path_km", 3).alias("path_km"), F.round("net_km", 3).alias("net_km"), F.round(F.when(enough, F.try_divide("net_km", F.nullif(F.col("path_km"), F.lit(0.0)))), 3).alias("straightness"), F.round(F.when(enough, 1.18 * F.try_divide("sd", F.nullif(F.sqrt("step"), F.lit(0.0)))), 3).alias("sinuosity"), F.round(F.when(enough, F.col("mean_turn")), 3).alias("mean_turn"), F.round("tortuosity_hourly", 3).alias("tortuosity_hourly"), F.round("tortuosity_daily", 3).alias("tortuosity_daily"))


def reconstructable(track: DataFrame, anchor_rows: DataFrame | None = None, control: Reckoning | dict | None = None) -> DataFrame:
    """Per ID how directed the track is: net over path length, ``path_m, net_m, directedness``, and `gate`.

    With `anchor_rows` the gate only looks at records without a fix between their ends: net is the way from the
    deployment to the pop-up, and a share under `least_directedness` gives ``warn``, else ``pass``; without a pop-up
    it is ``unbounded``; records with fixes between have ``interior``. Without `anchor_rows` net is that of the reckoned track.
    """
    c = Reckoning.of(control)
    e = track.groupBy("ID").agg(F.max("path_m").alias("path_m"), F.max_by(F.struct("east_m", "north_m"), "datetime").alias("z"), F.min_by(F.struct("east_m", "north_m"), "datetime").alias("a"))
    net = F.sqrt((F.col("z.east_m") - F.col("a.east_m")) ** 2 + (F.col("z.north_m") - F.col("a.north_m")) ** 2)
    if anchor_rows is None:
        return e.select("ID", "path_m", net.alias("net_m"), F.try_divide(net, F.nullif(F.col("path_m"), F.lit(0.0))).alias("directedness"))
    up = anchor_rows.groupBy("ID").agg(F.count_if(~F.coalesce(F.col("quality").isin("Deploy", "Popup"), F.lit(False))).alias("inner"), F.max(F.when(F.col("quality") == "Popup", F.sqrt(F.col("a_east") ** 2 + F.col("a_north") ** 2))).alias("net_m"))
    d = F.when(F.col("path_m") > 0, F.least(F.col("net_m") / F.col("path_m"), F.lit(1.0))).when(F.col("net_m") > 0, 1.0).otherwise(0.0)
    d = F.when((F.col("inner") == 0) & F.col("net_m").isNotNull(), d)
    gate = F.when(F.col("inner") > 0, "interior").when(F.col("net_m").isNull(), "unbounded").when(d < c.least_directedness, "warn").otherwise("pass")
    return e.join(up, "ID").select("ID", "path_m", "net_m", d.alias("directedness"), gate.alias("gate"))


def export_for_ssm(track: DataFrame, minutes: int = 5, lon: str = "pseudo_lon", lat: str = "pseudo_lat", error: str | None = None) -> DataFrame:
    """The first whole row of each bin of `minutes` since the epoch: ``id, date, lc, lon, lat, x_sd, y_sd``.

    The class is ``GL`` where the error is known, else ``G``."""
    ok = track.where(f"{lon} is not null and {lat} is not null and not isnan({lon}) and not isnan({lat})")
    first = first_per_bin(ok, F.floor(F.unix_micros("datetime") / (minutes * 60_000_000)))
    e = F.when(~F.isnan(error), F.col(error)) if error else F.lit(None).cast("double")
    return first.select(F.col("ID").alias("id"), F.col("datetime").alias("date"), F.when(e.isNotNull(), "GL").otherwise("G").alias("lc"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), e.alias("x_sd"), e.alias("y_sd"))


def speed_calibration(track: DataFrame, anchor_rows: DataFrame, least_legs: int = 4, least_straightness: float = 0.9, least_s: float = 60.0, least_m: float = 100.0, max_speed: float | None = None) -> DataFrame:
    """Slope and intercept of leg speed on mean vedba over straight legs between anchors (all records together).

    A leg's straightness is net over path length of its headings at unit speed along the body. Legs under `least_s`,
    `least_m` between their anchors, or `least_straightness` do not take part, nor those that would need more than
    `max_speed` (by default that of `Reckoning`). Speed is along the body: metres between the anchors over the
    horizontal path at unit speed.
    """
    fastest = Reckoning().max_speed if max_speed is None else max_speed
    w = Window.partitionBy("ID").orderBy("datetime")
    spans = anchor_rows.withColumn("t", F.unix_micros("datetime")).withColumn("t2", F.lead("t").over(w)).withColumn("e2", F.lead("a_east").over(w)).withColumn("n2", F.lead("a_north").over(w)).where(F.col("t2") - F.col("t") >= least_s * 1e6)
    spans = spans.withColumn("metres", F.sqrt((F.col("e2") - F.col("a_east")) ** 2 + (F.col("n2") - F.col("a_north")) ** 2)).where(F.col("metres") >= least_m)
    # A row's step leads to it, so a row at an anchor's time ends the leg before.
    steps = track.withColumn("__dt", seconds() - F.lag(seconds()).over(w))
    flat = F.cos(F.radians("pitch")) * F.col("__dt")
    steps = steps.select("ID", F.unix_micros("datetime").alias("t"), "vedba", F.lag("vedba").over(w).alias("v0"), flat.alias("s"), (flat * F.sin(F.radians("heading"))).alias("e"), (flat * F.cos(F.radians("heading"))).alias("n"), F.lit(0).alias("kind"))
    none = [F.lit(None).cast("double").alias(c) for c in ("vedba", "v0", "s", "e", "n")]
    rows = steps.unionByName(spans.select("ID", "t", "t2", *none, F.lit(1).alias("kind")), allowMissingColumns=True)
    o = Window.partitionBy("ID").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    x = F.last(F.when(F.col("kind") == 1, F.struct("t", "t2")), True).over(o)
    legged = rows.withColumn("x", x).where("kind = 0 and t <= x.t2").withColumn("leg", F.col("x.t"))
    first = F.min_by("v0", "t")  # the row at or before the anchor counts in the mean
    each = legged.groupBy("ID", "leg").agg(((F.sum("vedba") + F.coalesce(first, F.lit(0.0))) / (F.count("vedba") + first.isNotNull().cast("int"))).alias("v"), F.sum("s").alias("path"), F.sqrt(F.sum("e") ** 2 + F.sum("n") ** 2).alias("net"))
    straight = each.where(F.col("net") >= least_straightness * F.col("path")).join(spans.select("ID", F.col("t").alias("leg"), "metres"), ["ID", "leg"])
    used = straight.withColumn("speed", F.try_divide("metres", F.nullif(F.col("path"), F.lit(0.0)))).where((F.col("speed") <= fastest) & F.col("v").isNotNull())
    fit = used.agg(F.count(F.lit(1)).alias("legs"), F.regr_slope("speed", "v").alias("slope"), F.regr_intercept("speed", "v").alias("intercept"))
    good = (F.col("legs") >= least_legs) & (F.col("slope") > 0)
    return fit.select("legs", F.when(good, F.col("slope")).alias("slope"), F.when(good, F.col("intercept")).alias("intercept"))
