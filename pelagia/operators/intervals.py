"""Continuous periods and gaps of intervals, by canonical dyadic blocks.

Bounds are whole microseconds. They are doubled (a bound `t` is the point ``2t``, an interval the points
``2*start .. 2*end``), so intervals that share a bound share a point and touching is overlapping, while
intervals one microsecond apart stay apart.

1. Each task coalesces what overlaps among the intervals that it reads, so repeated and nested ones shrink
   before the shuffle.
2. An interval is cut at the borders of *cells* (dyadic blocks of level `top`). A piece ``lo .. hi`` within its cell
   stands for its canonical blocks (its bounds' bits tell them), so one row moves and not one per block.
3. Per key and cell a kernel decomposes the pieces into canonical dyadic blocks ``(level, index)``, removes
   blocks covered by an ancestor, merges sibling pairs upward and coalesces adjacent blocks into runs.
4. Runs that touch the edge of their cell are joined with the run in the next cell. Only such runs (at most two
   per key and cell, so bounded by the time they span) are put in order per key; the others stay with their cell.
5. Gaps come from the same pass: each period sends its end to the buckets of time in which the next start may
   lie, and finds the latest end before its own start there.

A key that holds a third of all rows is thus spread over its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.grouped import numbers, over_sorted_groups

#: A cell is 2**33 half microseconds, about 72 minutes; whole cells are numbered in groups of 2**10.
TOP, WIDE = 33, 10


def _premerge(keys: list[str], most: int = 1 << 20):
    """Coalesces what overlaps or touches, among at most about `most` intervals at a time."""

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(held).combine_chunks()
        s, e = numbers(data, "__s"), numbers(data, "__e")
        group = np.zeros(len(s), np.int64)
        for k in keys:
            c = data.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            group = np.unique(group * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((e, s, group))
        s, e, group = s[order], e[order], group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        reach = np.empty_like(e)
        for a, b in zip(first, np.r_[first[1:], len(e)]):
            reach[a:b] = np.maximum.accumulate(e[a:b])
        new = np.r_[True, (group[1:] != group[:-1]) | (s[1:] > reach[:-1])]
        at = np.flatnonzero(new)
        last = np.r_[at[1:] - 1, len(s) - 1]
        kept = data.select(keys).take(pa.array(order[at]))
        out = pa.table({k: kept.column(k).cast(pa.string()) for k in keys} | {"__s": pa.array(s[at]), "__e": pa.array(reach[last])})
        yield from out.to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most:
                yield from settle(held)
                held, rows = [], 0
        if held:
            yield from settle(held)

    return run


def pieces(df: DataFrame, start: str, end: str, top: int = TOP) -> DataFrame:
    """`df` with one row per piece of an interval: `cell` and the half-open bounds `lo`, `hi` in half microseconds. Cells
    are unfolded in two steps, so no array grows with an interval's length beyond 2**WIDE."""
    df = df.withColumn("__lo", F.expr(f"2 * {start}")).withColumn("__hi", F.expr(f"2 * {end} + 1"))
    df = df.withColumn("__c0", F.expr(f"shiftright(__lo, {top})")).withColumn("__c1", F.expr(f"shiftright(__hi - 1, {top})"))
    df = df.withColumn("__g", F.explode(F.expr(f"sequence(shiftright(__c0, {WIDE}), shiftright(__c1, {WIDE}))")))
    df = df.withColumn("cell", F.explode(F.expr(f"sequence(greatest(__c0, shiftleft(__g, {WIDE})), least(__c1, shiftleft(__g + 1, {WIDE}) - 1))")))
    return df.withColumn("lo", F.expr(f"greatest(__lo, shiftleft(cell, {top}))")).withColumn("hi", F.expr(f"least(__hi, shiftleft(cell + 1, {top}))")).drop("__lo", "__hi", "__c0", "__c1", "__g")


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The canonical blocks of pieces ``lo .. hi`` (half-open, within a cell of level `top`): which piece, level, begin.

    At each level below the cell's a piece takes the block at its left end if that is a right sibling, and the block at
    its right end if that is a left sibling; what is left goes up a level. At most two blocks a level.
    """
    of, level, begin = [], [], []
    a, b, which = lo.copy(), hi.copy(), np.arange(len(lo))
    for l in range(top + 1):
        size = np.int64(1) << np.int64(l)
        if l == top:
            take = which
            of.append(take)
            level.append(np.full(len(take), l))
            begin.append(a)
            break
        left = (a >> l) & 1 == 1
        of.append(which[left])
        level.append(np.full(int(left.sum()), l))
        begin.append(a[left])
        a = np.where(left, a + size, a)
        right = ((b >> l) & 1 == 1) & (a < b)
        b = np.where(right, b - size, b)
        of.append(which[right])
        level.append(np.full(int(right.sum()), l))
        begin.append(b[right])
        more = a < b
        a, b, which = a[more], b[more], which[more]
        if not len(which):
            break
    return np.concatenate(of), np.concatenate(level).astype(np.int64), np.concatenate(begin)


def _coalesce(keys: list[str], top: int, most: int = 200_000):
    types = {k: pa.string() for k in keys}

    def runs(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, begin and end of the runs of pieces that come sorted by group."""
        of, level, begin = dyadic_blocks(lo, hi, top)
        group = group[of]
        # Blocks of a group are laminar: sorted by start, larger first, a block is covered if an earlier one ends behind it.
        order = np.lexsort((-level, begin, group))
        group, level, begin = group[order], level[order], begin[order]
        stop = begin + (np.int64(1) << level)
        base = begin[np.searchsorted(group, group)] >> top << top  # where the group's cell begins
        shifted = (stop - base) + ((group - group[0]) << np.int64(top + 1))
        reach = np.maximum.accumulate(shifted)
        keep = np.r_[True, (group[1:] != group[:-1]) | (shifted[1:] > reach[:-1])]
        group, level, begin = group[keep], level[keep], begin[keep]
        for l in range(top):  # merge sibling pairs upward
            at = np.flatnonzero(level == l)
            if len(at) < 2:
                continue
            pair = at[:-1][(np.diff(at) == 1) & (group[at[1:]] == group[at[:-1]]) & (begin[at[1:]] - begin[at[:-1]] == 1 << l) & ((begin[at[:-1]] >> l) % 2 == 0)]
            if len(pair):
                level[pair] = l + 1
                left = np.ones(len(level), bool)
                left[pair + 1] = False
                group, level, begin = group[left], level[left], begin[left]
        stop = begin + (np.int64(1) << level)
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (begin[1:] != stop[:-1])])
        return group[first], begin[first], stop[np.r_[first[1:] - 1, len(group) - 1]]

    def kernel(data: pa.Table, starts: np.ndarray) -> pa.Table:
        lo, hi = numbers(data, "lo"), numbers(data, "hi")
        group = np.zeros(len(lo), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(lo):  # whole groups, about `most` pieces at a time
            b = int(np.searchsorted(group, group[min(a + most, len(lo)) - 1], "right"))
            found.append(runs(group[a:b], lo[a:b], hi[a:b]))
            a = b
        g, begin, stop = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        at = pa.array(starts[g] if len(g) else np.zeros(0, np.int64))
        out = {k: data.column(k).take(at).cast(t) for k, t in types.items()}
        out["cell"] = data.column("cell").take(at).cast(pa.int64())
        return pa.table(out | {"lo": pa.array(begin), "hi": pa.array(stop)})

    return kernel


def continuous_periods(df: DataFrame, keys: list[str], start: str, end: str, top: int = TOP) -> DataFrame:
    """The continuous periods per key: ``*keys, start_us, end_us`` (microseconds, both inclusive).

    `start` and `end` are bigint columns of microseconds; `keys` are string columns, NULL being a key of its
    own. Rows with a NULL bound or with end before start are left out; end equal to start is a period of
    one instant. Repeated, nested, overlapping and touching intervals give one period. Extra columns are
    ignored; an empty table gives an empty result.
    """
    names = ", ".join(f"{k} string" for k in keys)
    span = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e")).where("__s is not null and __e is not null and __e >= __s").mapInArrow(_premerge(keys), names + ", __s bigint, __e bigint")
    cut = pieces(span, "__s", "__e", top).select(*keys, "cell", "lo", "hi")
    runs = over_sorted_groups(cut, [*keys, "cell"], ["lo"], _coalesce(keys, top), names + ", cell bigint, lo bigint, hi bigint")
    size = 1 << top
    # A run inside its cell is a period of its own and stays with its cell; runs at edges of cells meet per key.
    part = F.when(F.expr(f"lo = cell * {size} or hi = (cell + 1) * {size}"), None).otherwise(F.col("cell"))
    w = Window.partitionBy(*keys, "part").orderBy("lo")
    chained = runs.select(*keys, part.alias("part"), "lo", "hi").withColumn("chain", F.sum(F.when(F.lag("hi").over(w) == F.col("lo"), 0).otherwise(1)).over(w))
    return chained.groupBy(*keys, "part", "chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*keys, F.expr("lo div 2").alias("start_us"), F.expr("(hi - 1) div 2").alias("end_us"))


def _with_gaps(periods: DataFrame, keys: list[str], longest_us: int) -> DataFrame:
    """Periods with `before`: the end of the period before, if it is at most `longest_us` earlier.

    Periods meet in buckets of `longest_us`: an end is sent to its own and the next bucket, so a key's periods
    are spread over its buckets and never sorted in one task.
    """
    mark = "named_struct('at', {at}, 'opens', {opens}, 'bucket', cast(floor({at} / {long}) as bigint) + {more}, 'until', end_us)"
    marks = ", ".join(mark.format(at=at, opens=opens, more=more, long=longest_us) for at, opens, more in (("start_us", 1, 0), ("end_us", 0, 0), ("end_us", 0, 1)))
    met = periods.select(*keys, F.expr(f"inline(array({marks}))"))
    w = Window.partitionBy(*keys, "bucket").orderBy("at", F.desc("opens")).rowsBetween(Window.unboundedPreceding, -1)
    # Periods are disjoint and no instant is shared, so the latest earlier end belongs to the period before.
    before = F.max(F.when(F.col("opens") == 0, F.col("at"))).over(w)
    near = met.withColumn("before", before).where("opens = 1")
    return near.select(*keys, F.col("at").alias("start_us"), F.col("until").alias("end_us"), F.when((F.col("before") < F.col("at")) & (F.col("at") - F.col("before") <= longest_us), F.col("before")).alias("before"))


def gaps_between(periods: DataFrame, keys: list[str], longest_us: int) -> DataFrame:
    """Gaps of at most `longest_us` from the end of one period to the start of the next, per key."""
    return _with_gaps(periods, keys, longest_us).where("before is not null").select(*keys, F.col("before").alias("start_us"), F.col("start_us").alias("end_us"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, longest_gap_us: int = 6 * 3_600_000_000) -> DataFrame:
    """Rows ``*keys, kind, start_us, end_us`` with kind ``period`` or ``gap``; both come from one pass."""
    both = _with_gaps(continuous_periods(df, keys, start, end), keys, longest_gap_us)
    gap = "if(before is null, null, named_struct('kind', 'gap', 'start_us', before, 'end_us', start_us))"
    return both.select(*keys, F.expr(f"inline(array_compact(array(named_struct('kind', 'period', 'start_us', start_us, 'end_us', end_us), {gap})))"))
