"""Terms of whole texts as byte runs, the tables of bytes that the contracts name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tetrarank.operators.runs import byte_runs, byte_table, counted, flat, slices

#: Runs of [^\x00-\x40\x5B-\x60\x7B-\x7F] and of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F], A-Z lowered.
LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A), high=True, lower=True)
WORDS = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), high=True, lower=True)

terms = byte_runs

__all__ = ["LETTERS", "WORDS", "arrays", "counted", "flat", "slices", "terms"]


def arrays(size: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of the given columns, each of `size` rows."""
    made = {n: c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for n, c in columns.items()}
    assert all(len(c) == size for c in made.values())
    return pa.RecordBatch.from_pydict(made)
