"""Whole groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], column: str, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, about ``rows`` rows at a time, with where the groups start.

    The stream is sorted by ``column``, a long; only the last group, which may go on, is held back.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column(column).to_numpy()
            cut = int(np.searchsorted(g, g[-1], "left"))
            if cut:
                yield table.slice(0, cut), _starts(g[:cut])
                held = table.slice(cut).to_batches()
                n -= cut
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table.column(column).to_numpy())


def _starts(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's start; one more start than rows."""
    column = column.combine_chunks()
    lists = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), starts
