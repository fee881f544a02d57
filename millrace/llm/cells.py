"""Rows that meet in cells: whole cells from a sorted stream of Arrow batches, and the pairs of rows within each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells up to this size are compared together, offset by offset; larger ones block by block.
SMALL = 64


def whole_cells(tables: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by their first `keys` columns, integers without nulls."""
    held: pa.Table | None = None
    for batch in tables:
        rows = pa.Table.from_batches([batch])
        held = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        if not held.num_rows:
            continue
        columns = [held.column(k).to_numpy() for k in range(keys)]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
        if len(other):  # all but the last cell are whole
            cut = int(other[-1]) + 1
            whole, held = held.slice(0, cut).combine_chunks(), held.slice(cut).combine_chunks()
            yield whole
    if held is not None and held.num_rows:
        yield held


def numbered(rows: pa.Table, keys: int) -> np.ndarray:
    """Numbers of the cells of rows that are sorted by their first `keys` columns."""
    columns = [rows.column(k).to_numpy() for k in range(keys)]
    return np.cumsum(np.concatenate([[False], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def row_pairs(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (x, y), x < y, of rows of one cell, in runs of bounded size. Rows of a cell stand together."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(cell)))
    x = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    last = np.repeat(starts + sizes, sizes)
    for d in range(1, SMALL):
        x = x[x + d < last[x]]
        if not len(x):
            break
        yield x, x + d
    for a, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for i in range(a, a + size, 256):
            p, q = np.meshgrid(np.arange(i, min(i + 256, a + size)), np.arange(i + 1, a + size), indexing="ij")
            up = q > p
            yield p[up], q[up]
