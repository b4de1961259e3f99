"""Arrow batches of array rows as matrices and back, and runs of rows that share a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers that a kernel gets at a time.
CHUNK = 1_000_000
#: Arrow types of the outputs that a schema may name.
KINDS = {
    "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
    "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
}


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows): the lists of a column as matrices of equal length, a bounded number of rows each.

    NULL lists are left out; missing values are NaN.
    """
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    lengths, known = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[known]).tolist():
        places = np.flatnonzero(known & (lengths == size))
        step = max(1, CHUNK // max(size, 1))
        for one in range(0, len(places), step):
            at = places[one : one + step]
            yield at, values[offsets[at][:, None] + np.arange(size)]


def padded(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """The lists of a column as one matrix; shorter ones and missing values are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    if len(column) and (lengths == lengths[0]).all() and not column.null_count:
        return values[offsets[0] : offsets[-1]].reshape(len(column), lengths[0]).copy()
    out = np.full((len(column), int(lengths.max(initial=0))), np.nan)
    inside = np.arange(out.shape[1]) < lengths[:, None]
    out[inside] = np.concatenate([values[a : a + n] for a, n in zip(offsets, lengths)]) if len(column) else []
    return out


def output(name: str, kind: str, cells: list) -> pa.Array:
    """One output column; NaN numbers are NULL, arrays stay as they are."""
    if kind in ("double", "int", "long"):
        cells = [None if c is None or c != c else c for c in cells]
    return pa.array(cells, KINDS[kind])


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``keys`` columns, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(i).to_pylist() for i in range(keys)]))
        start = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
