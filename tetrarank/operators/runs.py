"""Runs of bytes in whole text columns, found by a table of bytes and without a row loop; small Arrow helpers around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_table(*ranges: tuple[int, int], high: bool = False, lower: bool = False) -> np.ndarray:
    """What each byte becomes inside a run, 0 if it ends one. `high` keeps bytes from 0x80 up, so characters beyond ASCII stay whole."""
    table = np.zeros(256, np.uint8)
    if high:
        table[128:] = np.arange(128, 256)
    for first, last in ranges:
        table[first:last + 1] = np.arange(first, last + 1)
    if lower:
        table[0x41:0x5B] += np.where(table[0x41:0x5B] > 0, 32, 0).astype(np.uint8)
    return table


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def byte_runs(column: pa.Array | pa.ChunkedArray, table: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All runs of a column of texts in their order, and the row of each; no run goes over the end of a text."""
    raw, bounds = flat(column)
    mapped = table[raw]
    inside = mapped > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    begins[heads] = inside[heads]
    row = np.searchsorted(bounds, np.flatnonzero(begins), side="right") - 1
    offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(mapped[inside])]), row


def firsts(values: np.ndarray) -> np.ndarray:
    """Positions where a sorted array has a new value."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values ascending and how often each occurs."""
    values = np.sort(values)
    first = firsts(values)
    return values[first], np.diff(np.append(first, len(values)))


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many bytes of text and rows; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            used = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, used + size, side="right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column out of its bytes in order and the size of each value."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
