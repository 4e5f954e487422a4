"""Percentiles of large columns from mergeable rank-interval summaries.

A summary of `n` values is a sorted list of tuples ``(value, lo, hi)``: the value's rank lies between `lo` and
`hi`. It is deterministic. Summaries of disjoint parts merge: the ranks of a value add up, with what the
other summaries know about the values next to it. After a merge a summary is compressed to at most
``size + 1`` tuples, which adds at most ``n / (2 * size)`` to the error of a rank.

1. Each task summarises its own rows per group, without a shuffle: values are buffered per group, sorted and
   reduced to a summary with exact ranks.
2. Summaries are merged in a tree: a group's summaries are first spread over `salt` tasks, which read them one by
   one and keep at most `fan_in` of a level; then one task merges what the `salt` tasks made. So a group that holds
   a third of all rows is never gathered as rows, nor as an unbounded number of summaries.
3. The rank error is accumulated in the column `err` (in ranks) and reported next to each percentile.

Summaries of files or days can be stored and merged later in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.grouped import numbers

#: value, lowest rank, highest rank (from 1), number of values, accumulated error in ranks
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int, float]


def from_values(values: np.ndarray, size: int) -> Summary:
    """The summary of some values: exact if they are few, else `size` + 1 of them with their exact ranks."""
    v = np.sort(values)
    rank = np.arange(1, len(v) + 1)
    return compress((v, rank, rank, len(v), 0.0), size)


def compress(s: Summary, size: int) -> Summary:
    """At most `size` + 1 tuples, evenly spread over the ranks; the first and the last always stay."""
    v, lo, hi, n, err = s
    if len(v) <= size + 1:
        return s
    middle = (lo + hi) / 2
    at = np.unique(np.clip(np.searchsorted(middle, np.linspace(1, n, size + 1)), 0, len(v) - 1))
    at = np.unique(np.r_[0, at, len(v) - 1])
    return v[at], lo[at], hi[at], n, err + n / (2 * size)


def _two(a: Summary, b: Summary) -> Summary:
    """The summary of the values of both; no rank gets less certain than the sum of what was uncertain before."""
    av, al, ah, an, ae = a
    bv, bl, bh, bn, be = b
    low_a, high_a, low_b, high_b = np.r_[0, al], np.r_[ah, an + 1], np.r_[0, bl], np.r_[bh, bn + 1]
    in_b = np.searchsorted(bv, av, "left")  # ties: those of `a` come first
    in_a = np.searchsorted(av, bv, "right")
    at_a, at_b = np.arange(len(av)) + in_b, np.arange(len(bv)) + in_a
    v, lo, hi = np.empty(len(av) + len(bv)), np.empty(len(av) + len(bv), np.int64), np.empty(len(av) + len(bv), np.int64)
    v[at_a], v[at_b] = av, bv
    lo[at_a], lo[at_b] = al + low_b[in_b], bl + low_a[in_a]
    hi[at_a], hi[at_b] = ah + high_b[in_b] - 1, bh + high_a[in_a] - 1
    return v, lo, hi, an + bn, ae + be


def merge(parts: list[Summary], size: int) -> Summary:
    """The summary of all values of `parts`: in pairs, in pairs of pairs and so on, compressed once at the end."""
    parts = [p for p in parts if p[3]]
    if not parts:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0.0
    while len(parts) > 1:
        parts = [_two(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return compress(parts[0], size)


def quantile(s: Summary, p: float) -> tuple[float, float]:
    """The value whose rank is nearest to ``1 + p (n - 1)``, and how far off its rank can be at most."""
    v, lo, hi, n, err = s
    want = 1 + p * (n - 1)
    far = np.maximum(want - lo, hi - want)
    at = int(np.argmin(far))
    return float(v[at]), float(max(far[at], 0.0))


_FIELDS = [("v", pa.list_(pa.float64())), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("n", pa.int64()), ("err", pa.float64())]
_DDL = "v array<double>, lo array<bigint>, hi array<bigint>, n bigint, err double"


def summarise(df: DataFrame, keys: list[str], value: str, size: int = 1000, buffer: int = 1 << 22) -> DataFrame:
    """One or a few summaries per group and task: ``*keys, part, v, lo, hi, n, err``.

    `keys` are string columns, NULL being a group of its own; NULL and NaN values do not count. A task holds
    at most `buffer` values, then it sends what it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        context = pyspark.TaskContext.get()
        part = context.partitionId() if context else 0
        schema = pa.schema([*[(k, pa.string()) for k in keys], ("part", pa.int64()), *_FIELDS])
        held: dict[tuple, list[np.ndarray]] = {}
        done: dict[tuple, list[Summary]] = {}
        rows = 0

        def settle() -> None:
            nonlocal rows
            for key, chunks in held.items():
                done.setdefault(key, []).append(from_values(np.concatenate(chunks), size))
                if len(done[key]) > 16:
                    done[key] = [merge(done[key], size)]
            held.clear()
            rows = 0

        def send() -> Iterator[pa.RecordBatch]:
            names, made = list(done), [merge(parts, size) for parts in done.values()]
            done.clear()
            for i in range(0, len(made), 500):
                yield _batch([[k[j] for k in names[i : i + 500]] for j in range(len(keys))], [part] * len(made[i : i + 500]), made[i : i + 500], schema)

        for batch in batches:
            data = pa.Table.from_batches([batch])
            x = numbers(data, value).astype(float)
            ok = np.flatnonzero(~np.isnan(x))
            if not len(ok):
                continue
            code, labels = np.zeros(len(x), np.int64), [()]
            for k in keys:
                c = data.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                names = c.dictionary.to_pylist()
                code = code * len(names) + c.indices.to_numpy(zero_copy_only=False)
                labels = [(*a, b) for a in labels for b in names]
            order = ok[np.argsort(code[ok], kind="stable")]
            cut = np.flatnonzero(np.diff(code[order])) + 1
            for chunk in np.split(order, cut):
                held.setdefault(labels[code[chunk[0]]], []).append(x[chunk])
            rows += len(ok)
            if rows >= buffer:
                settle()
                if sum(len(p) for p in done.values()) * size > buffer:
                    yield from send()
        settle()
        yield from send()

    return df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).cast("double").alias(value)).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", part bigint, " + _DDL)


def _batch(keys: list[list], part: list[int], made: list[Summary], schema: pa.Schema) -> pa.RecordBatch:
    ends = pa.array(np.r_[0, np.cumsum([len(m[0]) for m in made])].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m[k] for m in made] or [np.zeros(0)]).astype(float if k == 0 else np.int64))) for k in range(3)]
    return pa.RecordBatch.from_arrays([*[pa.array(k, pa.string()) for k in keys], pa.array(part, pa.int64()), *lists, pa.array([m[3] for m in made], pa.int64()), pa.array([m[4] for m in made], pa.float64())], schema=schema)


def _summaries(batch: pa.RecordBatch) -> list[Summary]:
    """The summaries of a batch's rows, read from the flat values of its lists."""
    ends = batch.column("v").offsets.to_numpy()
    flat = [batch.column(c).values.to_numpy() for c in ("v", "lo", "hi")]
    n, err = batch.column("n").to_pylist(), batch.column("err").to_pylist()
    return [(*[f[a:b] for f in flat], n[i], err[i]) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]


class _Tower:
    """Summaries of one group, at most `fan_in` - 1 of each level: so many of a level make one of the next."""

    def __init__(self, size: int, fan_in: int):
        self.size, self.fan_in, self.levels = size, fan_in, []

    def add(self, s: Summary) -> None:
        for level in self.levels:
            level.append(s)
            if len(level) < self.fan_in:
                return
            s = merge(level, self.size)
            level.clear()
        self.levels.append([s])

    def top(self) -> Summary:
        return merge([s for level in self.levels for s in level], self.size)


def _merging(keys: list[str], size: int, fan_in: int):
    """The ``mapInArrow`` function that merges the summaries of each group of `keys` and `part`, which come one behind another."""
    schema = pa.schema([*[(k, pa.string()) for k in keys], ("part", pa.int64()), *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tower = None, _Tower(size, fan_in)
        done: list[tuple[tuple, Summary]] = []

        def send() -> pa.RecordBatch:
            rows = _batch([[k[j] for k, _ in done] for j in range(len(keys))], [k[-1] for k, _ in done], [m for _, m in done], schema)
            done.clear()
            return rows

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in [*keys, "part"])))
            for key, s in zip(names, _summaries(batch)):
                if key != now:
                    if now is not None:
                        done.append((now, tower.top()))
                        if len(done) >= 500:
                            yield send()
                    now, tower = key, _Tower(size, fan_in)
                tower.add(s)
        if now is not None:
            done.append((now, tower.top()))
        if done:
            yield send()

    return run


def combine(summaries: DataFrame, keys: list[str], size: int = 1000, fan_in: int = 64, salt: int = 16) -> DataFrame:
    """One summary per group of `keys` (some of the summaries' own keys), however many a group has."""
    schema = ", ".join(f"{k} string" for k in keys) + ", part bigint, " + _DDL
    others = [c for c in summaries.columns if c not in {*keys, "v", "lo", "hi", "n", "err"}]
    level = summaries.select(*keys, F.pmod(F.xxhash64(*others), F.lit(salt)).alias("part"), "v", "lo", "hi", "n", "err")
    for part in (F.col("part"), F.lit(0).cast("bigint")):
        level = level.withColumn("part", part).repartition(*keys, "part").sortWithinPartitions(*keys, "part", "n", "err").mapInArrow(_merging(keys, size, fan_in), schema)
    return level


def percentiles(summaries: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """``*keys, n``, a column per percentile, and ``rank_error``: the most that a rank can be off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(k, pa.string()) for k in keys], ("n", pa.int64()), *[(name, pa.float64()) for name in probabilities], ("rank_error", pa.float64())])
        for batch in batches:
            out = []
            for k, s in enumerate(_summaries(batch)):
                found = {name: quantile(s, p) for name, p in probabilities.items()}
                out.append({key: batch.column(key)[k].as_py() for key in keys} | {"n": s[3], "rank_error": max(f[1] for f in found.values())} | {name: f[0] for name, f in found.items()})
            yield pa.RecordBatch.from_pylist(out, schema)

    return summaries.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", n bigint, " + ", ".join(f"{name} double" for name in probabilities) + ", rank_error double")
