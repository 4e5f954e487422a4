"""Records paired with the nearest record in time of the same entity, by a learned index per shard.

Rows of both tables meet in shards ``(entity, time cell)``. Rows of the searched table that lie within the
tolerance of a cell's edge also go to the neighbour (the shards' edges overlap), so every query row has its
whole neighbourhood in its own shard and is answered once. In a shard the distinct times are a sorted
array; a piecewise linear model predicts a time's position in it. Pieces are split until no prediction is
off by more than `error` positions, so a search of ``2 * error + 3`` entries around the prediction is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.grouped import numbers, over_sorted_groups


def fit_pieces(key: np.ndarray, bounds: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each linear piece over increasing `key`.

    `bounds` are the positions at which a shard begins (no piece crosses one). A piece runs through its
    end points; it is halved until it predicts all of its positions within `error`.
    """
    lo, hi = bounds.copy(), np.r_[bounds[1:], len(key)] - 1
    done_lo, done_hi = [], []
    while len(lo):
        size = hi - lo + 1
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        slope = np.where(hi > lo, (hi - lo) / np.maximum(key[hi] - key[lo], 1), 0.0)
        miss = np.abs(np.repeat(lo, size) + (key[at] - np.repeat(key[lo], size)) * np.repeat(slope, size) - at)
        worst = np.maximum.reduceat(miss, np.r_[0, np.cumsum(size)[:-1]])
        good = worst <= error
        done_lo.append(lo[good])
        done_hi.append(hi[good])
        lo, hi = lo[~good], hi[~good]
        middle = (lo + hi) // 2
        lo, hi = np.r_[lo, middle + 1], np.r_[middle, hi]
    lo, hi = np.concatenate(done_lo), np.concatenate(done_hi)
    order = np.argsort(lo)
    return lo[order], hi[order]


def search(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, query: np.ndarray, first: np.ndarray, last: np.ndarray, error: int) -> np.ndarray:
    """Position of the nearest key for each query within its shard ``first..last``; the earlier one on ties."""
    piece = np.clip(np.searchsorted(key[lo], query, "right") - 1, 0, len(lo) - 1)
    piece = np.where(lo[piece] < first, piece + 1, piece)  # before the first key of its shard
    a, b = lo[piece], hi[piece]
    slope = np.where(b > a, (b - a) / np.maximum(key[b] - key[a], 1), 0.0)
    guess = np.clip(np.rint(a + (query - key[a]) * slope), a, b).astype(np.int64)
    near = np.clip(guess[:, None] + np.arange(-error - 1, error + 2)[None, :], first[:, None], last[:, None])
    away = np.abs(key[near] - query[:, None])
    return near[np.arange(len(query)), np.argmin(away, axis=1)]


def _kernel(tolerance_us: int, error: int):
    def kernel(data: pa.Table, starts: np.ndarray) -> pa.Table:
        asks, t, rid = (numbers(data, c) for c in ("asks", "t_us", "rid"))
        group = np.zeros(len(t), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        have, want = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
        empty = pa.table({"query_id": pa.array([], pa.int64()), "found_id": pa.array([], pa.int64()), "distance_us": pa.array([], pa.int64())})
        if not len(have) or not len(want):
            return empty
        # Rows come in order of time and id: the first of a time is the one with the smallest id.
        have = have[np.r_[True, (group[have[1:]] != group[have[:-1]]) | (t[have[1:]] != t[have[:-1]])]]
        base = t[starts]
        width = np.int64(int(np.max(t - base[group])) + int(tolerance_us) + 2) * 2
        key = group[have] * width + (t[have] - base[group[have]])
        bounds = np.flatnonzero(np.r_[True, group[have[1:]] != group[have[:-1]]])
        shard = np.full(len(starts), -1)
        shard[group[have[bounds]]] = np.arange(len(bounds))
        want = want[shard[group[want]] >= 0]
        if not len(want):
            return empty
        lo, hi = fit_pieces(key, bounds, error)
        ends = np.r_[bounds[1:], len(have)] - 1
        of = shard[group[want]]
        # A query may lie before its shard's first row of the searched table, so its offset can be negative.
        query = group[want] * width + np.clip(t[want] - base[group[want]], -(width // 2) + 1, None)
        found = search(key, lo, hi, query, bounds[of], ends[of], error)
        away = np.abs(t[have[found]] - t[want])
        ok = away <= tolerance_us
        return pa.table({"query_id": pa.array(rid[want][ok]), "found_id": pa.array(rid[have[found]][ok]), "distance_us": pa.array(away[ok])})

    return kernel


def nearest_in_time(queries: DataFrame, rows: DataFrame, tolerance_us: int, cell_us: int = 3_600_000_000, error: int = 8) -> DataFrame:
    """Pairs ``query_id, found_id, distance_us``: each query row with the nearest row in time of its entity.

    Both tables have ``entity`` (string), ``t_us`` (bigint) and ``rid`` (bigint, unique per table). Rows with
    a NULL in one of them are left out; query rows without a partner within `tolerance_us` (inclusive) have
    no pair. Among rows of one time the smallest id counts, of two times equally near the earlier one.
    Extra columns are ignored. An empty table gives an empty result.
    """
    assert 0 <= tolerance_us < cell_us // 2
    whole = "entity is not null and t_us is not null and rid is not null"
    home = F.expr(f"floor(t_us / {cell_us})").cast("bigint")
    into = F.expr(f"t_us - floor(t_us / {cell_us}) * {cell_us}")
    cells = F.when(into <= tolerance_us, F.array(home, home - 1)).when(into >= cell_us - tolerance_us, F.array(home, home + 1)).otherwise(F.array(home))
    have = rows.where(whole).select("entity", F.explode(cells).alias("cell"), F.lit(0).alias("asks"), "t_us", "rid")
    want = queries.where(whole).select("entity", home.alias("cell"), F.lit(1).alias("asks"), "t_us", "rid")
    return over_sorted_groups(have.unionByName(want), ["entity", "cell"], ["t_us", "asks", "rid"], _kernel(tolerance_us, error), "query_id bigint, found_id bigint, distance_us bigint")
