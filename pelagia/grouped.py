"""Vectorised kernels over sorted groups.

`over_sorted_groups` shuffles once on the keys, sorts inside the partitions and streams Arrow batches
to a kernel. A kernel gets many whole groups at a time as NumPy arrays, so the cost of a call is paid
per batch and not per group (which ``applyInPandas`` would do). A group is held whole, so the keys have
to bound it: callers put a time cell or another shard among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _boundaries(data: pa.Table, keys: list[str]) -> np.ndarray:
    """Indices at which a group begins."""
    change = np.zeros(len(data), bool)
    if len(data):
        change[0] = True
    for key in keys:
        column = data.column(key)
        if not pa.types.is_integer(column.type) or column.null_count:
            whole = column.combine_chunks()
            if isinstance(whole, pa.ChunkedArray):
                whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)
            column = whole.dictionary_encode(null_encoding="encode").indices  # NULL is a key of its own
        values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def numbers(data: pa.Table, name: str) -> np.ndarray:
    """A column as float64 (NULL becomes NaN) or as int64 if it is an integer column without NULL."""
    column = data.column(name)
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.cast(pa.float64()).to_numpy().astype(float, copy=False)


def stream(kernel: Callable[[pa.Table, np.ndarray], pa.Table], keys: list[str], flush_rows: int = 1 << 17):
    """The ``mapInArrow`` function that cuts a sorted stream into whole groups for `kernel`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < flush_rows:
                continue
            data = pa.Table.from_batches(held)
            starts = _boundaries(data, keys)
            if len(starts) < 2:
                flush_rows_now = rows  # one group fills it all: wait until it has doubled
                rows = flush_rows_now // 2
                continue
            whole = int(starts[-1])
            yield from kernel(data.slice(0, whole), starts[:-1]).to_batches(max_chunksize=1 << 16)
            held, rows = data.slice(whole).to_batches(), len(data) - whole
        if held:
            data = pa.Table.from_batches(held)
            yield from kernel(data, _boundaries(data, keys)).to_batches(max_chunksize=1 << 16)

    return run


def over_sorted_groups(df: DataFrame, keys: list[str], order: list[str], kernel, schema: str) -> DataFrame:
    """Apply `kernel(table, group_starts) -> table` to all groups of `keys`, each sorted by `order`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream(kernel, keys), schema)
