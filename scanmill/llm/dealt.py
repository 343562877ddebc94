"""Rows that were dealt out and sorted by a key, as one table per key, across Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, ends): whole keys only, rows ends[i] to ends[i + 1] having one key. Memory: a batch and the longest key."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _starts(batch, key)
        first = {k: batch.column(k)[0].as_py() for k in key}
        new = last is not None and first != last
        last = {k: batch.column(k)[batch.num_rows - 1].as_py() for k in key}
        if not new and not len(cut):
            rest.append(batch)
            continue
        end = int(cut[-1]) if len(cut) else 0
        table = pa.Table.from_batches([*rest, batch.slice(0, end)]) if end else pa.Table.from_batches(rest)
        yield table, np.concatenate([[0], _starts(table, key), [table.num_rows]])
        rest = [batch.slice(end)]
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.concatenate([[0], _starts(table, key), [table.num_rows]])


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    for table, ends in spans(batches, key):
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield table.slice(int(a), int(b - a))


def _starts(rows: pa.RecordBatch | pa.Table, key: list[str]) -> np.ndarray:
    """Row numbers, but the first, at which a new key starts."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in key:
        column = rows.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        new |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1
