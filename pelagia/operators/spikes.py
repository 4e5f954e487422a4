"""Implausible readings: robust exponentially weighted control charts per source.

A *source* is one channel of one (ID, file_no). Its readings are taken in time order, without missing
ones and without repeated rows. Three kinds of readings are flagged:

``spike``
    The chart keeps an exponentially weighted level and scale. A reading outside the control limits is a
    suspect; it is clipped to the limit before it may update level and scale, so it cannot hide itself. A
    run of at most `longest_spike` suspects from which the series comes back is a candidate, and is
    confirmed if it lies further from its surroundings than `beyond` times the largest step which the
    whole source makes between accepted readings.
``impossible``
    The value is outside the physical limits of the channel.
``stuck``
    Run-length counters: the reading repeats the one before it in a run of equal values that is far
    longer than the source's other runs. What is ordinary comes from the source's own run lengths: the
    histograms of the shards add up, and where the sorted lengths leap from `a` to more than
    ``stuck_ratio * a + stuck_more``, the few runs (at most the share `stuck_share`, but always one) above
    the leap are stuck. A sensor that holds every value for a while has no such leap.

Sources are cut into shards by time (`cell_s` seconds, with `margin_s` seconds of the neighbours on both
sides), so a source that holds a third of all rows is spread over many tasks. Only candidates and one
row of statistics (and a histogram of run lengths) per shard leave the kernel; they are combined by max and sum
per source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.grouped import numbers, over_sorted_groups
from pelagia.operators import unit_texts
from pelagia.runtime import cut


@dataclass(frozen=True)
class SpikeControl:
    """Parameters of the charts. Limits are in common units: m, g, µT."""

    cell_s: int = 2 * 86_400
    margin_s: int = 7_680
    level_weight: float = 0.7
    scale_weight: float = 0.05
    limit: float = 5.5
    longest_spike: int = 4
    beyond: float = 2.8
    odd_steps: float = 0.001
    gap_factor: float = 5.0
    stuck_ratio: float = 1.7
    stuck_more: int = 4
    stuck_share: float = 0.02
    limits: dict = field(default_factory=lambda: {"depth": (-10.0, 11_000.0), "ax": (-60.0, 60.0), "mx": (-1_500.0, 1_500.0)})


def chart(x: np.ndarray, t: np.ndarray, floor: float, gap: float, c: SpikeControl) -> tuple[list[tuple[int, int]], list[int]]:
    """Runs (begin, end) of suspects from which the series came back, and where its level shifted for good."""
    found: list[tuple[int, int]] = []
    shifts: list[int] = []
    values, times = x.tolist(), t.tolist()
    level, scale, begin, last = values[0], floor, -1, times[0]
    lw, sw, lim, longest = c.level_weight, c.scale_weight, c.limit, c.longest_spike
    for i, v in enumerate(values):
        now = times[i]
        if now - last > gap:  # a change across a gap in time is no case
            level, scale, begin = v, max(scale, floor), -1
        last = now
        r = v - level
        width = lim * scale
        if width < lim * floor:
            width = lim * floor
        if r > width or r < -width:
            if begin < 0:
                begin = i
            if i - begin >= longest:  # too long for a spike: the level has shifted
                shifts.append(begin)
                level, begin = v, -1
                scale += sw * (width / lim - scale)
                continue
            scale += sw * (width / lim - scale)
            continue
        if begin >= 0:
            found.append((begin, i))
            begin = -1
        level += lw * r
        scale += sw * ((r if r >= 0 else -r) * 1.2533 - scale)
    return found, shifts


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return begin, np.diff(np.r_[begin, len(x)])


def longest_ordinary(lengths: np.ndarray, c: SpikeControl) -> float:
    """The longest ordinary run among run lengths; infinite if none is far longer than the others."""
    size, many = np.unique(lengths, return_counts=True)
    if len(size) == 1:
        return 0.0 if many[0] == 1 and size[0] > c.stuck_more else np.inf
    above = np.cumsum(many[::-1])[::-1][1:]
    leap = (size[1:] > c.stuck_ratio * size[:-1] + c.stuck_more) & (above <= max(1.0, c.stuck_share * many.sum()))
    return float(size[np.argmax(leap)]) if leap.any() else np.inf


SCHEMA = "ID string, file_no bigint, channel string, kind string, record_id bigint, size double, run bigint"


def _kernel(channels: list[str], c: SpikeControl):
    def kernel(data: pa.Table, starts: np.ndarray) -> pa.Table:
        rid, t = numbers(data, "record_id"), numbers(data, "t_us") / 1e6
        core = data.column("core").to_numpy(zero_copy_only=False).astype(bool)
        ends = np.r_[starts[1:], len(rid)]
        rows: list[tuple[np.ndarray, str, str, np.ndarray, np.ndarray, np.ndarray]] = []
        for channel in channels:
            values = numbers(data, channel)
            for a, b in zip(starts.tolist(), ends.tolist()):
                ok = np.flatnonzero(~np.isnan(values[a:b])) + a
                if not len(ok):
                    continue
                v, tt = values[ok], t[ok]
                new = np.r_[True, (tt[1:] != tt[:-1]) | (v[1:] != v[:-1])]  # repeated rows follow each other
                of = np.cumsum(new) - 1
                x, tx = v[new], tt[new]
                n = len(x)
                begin, length = _runs(x)
                # No run of fewer readings can be far longer than another. In the chart only what stands out here is left out.
                long = length > c.stuck_more
                odd = long & (length > longest_ordinary(length, c))
                here = core[ok][new][begin]  # a run counts where it begins, so not twice
                lengths, counts = np.unique(length[here], return_counts=True)
                stuck, run = np.zeros(n, bool), np.zeros(n, np.int64)
                frozen = np.zeros(n, bool)
                for p, k, o in zip(begin[long].tolist(), length[long].tolist(), odd[long].tolist()):
                    stuck[p : p + k] = True
                    run[p : p + k] = k
                    frozen[p : p + k] = o
                # The chart starts anew after a stuck run, as after a gap in time.
                live = np.flatnonzero(~frozen)
                size, widest = np.zeros(n), 0.0
                if len(live) > 2:
                    y, ty = x[live], tx[live]
                    usual = float(np.median(np.diff(ty)))
                    gap = c.gap_factor * max(usual, 1e-6)
                    ty = ty + np.r_[0, np.cumsum(np.diff(live) > 1)] * (gap + 1)
                    step, dt = np.abs(np.diff(y)), np.diff(ty)
                    near = step[dt <= gap]
                    suspects, shifted = np.zeros(len(y), bool), np.zeros(len(y), bool)
                    if len(near):
                        floor = float(np.quantile(near, 0.9)) or float(near.max()) or 1e-9
                        runs, shifts = chart(y, ty, floor, gap, c)
                        shifted[shifts] = True
                        for p, q in runs:
                            suspects[p:q] = True
                            if p and ty[p] - ty[p - 1] <= gap and ty[q] - ty[q - 1] <= gap:
                                lo, hi = sorted((y[p - 1], y[q]))
                                size[live[p:q]] = np.maximum(np.maximum(y[p:q] - hi, lo - y[p:q]), 0)
                    calm = ~suspects[1:] & ~suspects[:-1] & ~shifted[1:] & (dt <= 1.6 * usual)
                    moves = np.sort(step[calm])
                    if len(moves):  # a few steps in a thousand may be shifts of the level that came to stay
                        widest = float(moves[max(0, len(moves) - 1 - math.ceil(c.odd_steps * len(moves)))])
                stuck[begin[long]] = False  # the first reading of a run is no case
                kinds = {"spike": size > 0, "stuck": stuck}
                rows.append((np.array([ok[0]]), channel, "stats", np.array([-1]), np.array([widest]), np.array([0])))
                rows.append((np.full(len(lengths), ok[0]), channel, "runs", np.full(len(lengths), -1), counts.astype(float), lengths))
                for kind, flag in kinds.items():
                    if flag.any():
                        hit = flag[of] & core[ok]
                        at = ok[hit]
                        rows.append((at, channel, kind, rid[at], size[of[hit]], run[of[hit]]))
        if not rows:
            return pa.table({f: pa.array([], ty) for f, ty in (("ID", pa.string()), ("file_no", pa.int64()), ("channel", pa.string()), ("kind", pa.string()), ("record_id", pa.int64()), ("size", pa.float64()), ("run", pa.int64()))})
        at = np.concatenate([r[0] for r in rows])
        many = [len(r[0]) for r in rows]
        return pa.table({
            "ID": data.column("ID").take(pa.array(at)).cast(pa.string()), "file_no": data.column("file_no").take(pa.array(at)).cast(pa.int64()),
            "channel": pa.array(np.repeat([r[1] for r in rows], many)), "kind": pa.array(np.repeat([r[2] for r in rows], many)),
            "record_id": pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)), "size": pa.array(np.concatenate([r[4] for r in rows]).astype(float)),
            "run": pa.array(np.concatenate([r[5] for r in rows]).astype(np.int64)),
        })

    return kernel


def flag_implausible(data: DataFrame, channels: tuple[str, ...] = ("depth", "ax", "mx"), control: SpikeControl | None = None) -> DataFrame:
    """Rows ``record_id, channel, kind`` of implausible readings; a reading may have several kinds.

    NULL and NaN readings are missing. Rows with a NULL ID, file_no, datetime or record_id belong to no
    source and are left out. Repeated rows (same source, time and value) share their flags. Extra columns
    are ignored. An empty table gives an empty result. Sources of one reading have no spikes and no runs.
    """
    c = control or SpikeControl()
    base = data.select("ID", F.col("file_no").cast("bigint").alias("file_no"), F.col("record_id").cast("bigint").alias("record_id"), F.unix_micros("datetime").alias("t_us"), *[F.col(x).cast("double").alias(x) for x in channels]).where("ID is not null and file_no is not null and record_id is not null and t_us is not null")
    cell, margin = c.cell_s * 1_000_000, c.margin_s * 1_000_000
    home = F.expr(f"floor(t_us / {cell})").cast("bigint")
    into = F.expr(f"t_us - floor(t_us / {cell}) * {cell}")
    cells = F.when(into < margin, F.array(home, home - 1)).when(into >= cell - margin, F.array(home, home + 1)).otherwise(F.array(home))
    shards = base.select("*", F.posexplode(cells).alias("nth", "cell")).withColumn("core", F.col("nth") == 0).drop("nth")
    marked = cut(over_sorted_groups(shards, ["ID", "file_no", "cell"], ["t_us", "record_id"], _kernel(list(channels), c), SCHEMA))
    source = ["ID", "file_no", "channel"]
    stats = marked.where("kind = 'stats'").groupBy(*source).agg(F.max("size").alias("widest"))
    # Run lengths of a source: few different ones (n readings have less than sqrt(2 n)), each with its number.
    lengths = marked.where("kind = 'runs'").groupBy(*source, "run").agg(F.sum("size").alias("many"))
    up, down = Window.partitionBy(*source).orderBy("run"), Window.partitionBy(*source).orderBy(F.desc("run"))
    all_runs = Window.partitionBy(*source)
    leaps = lengths.select(*source, "run", "many", F.lead("run").over(up).alias("next"), (F.sum("many").over(down) - F.col("many")).alias("above"), F.sum("many").over(all_runs).alias("runs"))
    leap = (F.col("next") > c.stuck_ratio * F.col("run") + c.stuck_more) & (F.col("above") <= F.greatest(F.lit(1.0), c.stuck_share * F.col("runs")))
    only = (F.col("runs") == 1) & (F.col("run") > c.stuck_more)
    ordinary = leaps.groupBy(*source).agg(F.min(F.when(leap, F.col("run")).when(only, 0)).alias("ordinary")).where("ordinary is not null")
    spike = marked.where("kind = 'spike'").join(stats, source).where(F.col("size") > c.beyond * F.col("widest"))
    stuck = marked.where("kind = 'stuck'").join(ordinary, source).where(F.col("run") > F.col("ordinary"))
    held = spike.select("record_id", "channel", "kind").unionByName(stuck.select("record_id", "channel", "kind"))
    return held.unionByName(impossible(base, channels, data, c)).distinct()


def impossible(base: DataFrame, channels: tuple[str, ...], data: DataFrame, c: SpikeControl) -> DataFrame:
    """Readings outside the physical limits, in the unit that the source's own vectors show."""
    wide = [x for x in channels if x in c.limits]
    scaled = [x for x in wide if x in unit_texts.FELT and {x, x[0] + "y", x[0] + "z"} <= set(data.columns)]
    out, factor = base, {x: F.lit(1.0) for x in wide}
    if scaled:
        norm = {x: F.sqrt(sum((F.col(x[0] + a).cast("double") ** 2 for a in "xyz"), F.lit(0.0))) for x in scaled}
        sizes = data.groupBy("ID", F.col("file_no").cast("bigint").alias("file_no")).agg(*[F.percentile_approx(F.when(~F.isnan(norm[x]), norm[x]), F.array(F.lit(0.5), F.lit(0.9)), 100).alias(f"{x}_size") for x in scaled])
        # No unit is smaller than the common one, so what is possible in that one takes no part in the join.
        least = {x: min(abs(v) for v in c.limits[x]) for x in wide}
        sizes = sizes.select("ID", "file_no", *[unit_texts.factor_by_size(x, [F.get(f"{x}_size", F.lit(n)) for n in (0, 1)]).alias(f"{x}_factor") for x in scaled])
        out = base.where(" or ".join(f"(not isnan({x}) and abs({x}) > {least[x]})" for x in wide)).join(sizes, ["ID", "file_no"], "left")
        factor |= {x: F.coalesce(F.col(f"{x}_factor"), F.lit(1.0)) for x in scaled}
    parts = []
    for x in wide:
        lo, hi = c.limits[x]
        value = F.when(~F.isnan(x), F.col(x) * factor[x])
        parts.append(F.when((value < lo) | (value > hi), F.lit(x)))
    return out.select("record_id", F.explode(F.array_compact(F.array(*parts))).alias("channel")).select("record_id", "channel", F.lit("impossible").alias("kind"))
