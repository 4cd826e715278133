"""Many short lists at once: after one shuffle a list lies in one task, and lists of equal length are computed together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers, and numbers of a matrix or cube that it computes at once.
GATHERED, NUMBERS = 65_536, 1_000_000


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number per distinct value, null among them."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    return array.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values with NaN for null, whether a value is there)."""
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64), there


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """First rows of the lists; rows of a list stand together."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        code = codes(table.column(c))
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole_lists(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole lists, with the first row of each list."""
    held, count, most = [], 0, GATHERED
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= most:
            table = pa.concat_tables(held)
            starts = _starts(table, by)
            if starts[-1]:
                yield table.slice(0, starts[-1]), starts[:-1]
            held = [table.slice(starts[-1])]
            count = held[0].num_rows
            most = max(GATHERED, 2 * count)
    if held:
        table = pa.concat_tables(held)
        yield table, _starts(table, by)


def per_list(rows: DataFrame, by: list[str], order: list, item: str, score: str, relevance: str, fn: Callable, out: dict[str, str], power: int) -> DataFrame:
    """by, and what `fn` gives for each list: `fn` gets (lists, rows) matrices of item codes, and of values and their presence for score and
    relevance, in the order of the list, and returns a vector of numbers per column of `out` (name, type), NaN for null.

    It holds `power` dimensions, 2 for the rows of a list and 3 for their pairs, which bounds how many lists it gets at once.
    """
    used = list(dict.fromkeys([*by, item, score, relevance]))
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], *[f"{n} {t}" for n, t in out.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_lists(batches, by):
            sizes = np.diff(np.append(starts, table.num_rows))
            columns = [codes(table.column(item)), *numbers(table.column(score)), *numbers(table.column(relevance))]
            found = np.full((len(out), len(starts)), np.nan)
            for n in np.unique(sizes):
                lists = np.flatnonzero(sizes == n)
                step = max(1, NUMBERS // int(n) ** (power - 1))
                for at in range(0, len(lists), step):
                    some = lists[at:at + step]
                    place = starts[some][:, None] + np.arange(n)
                    with np.errstate(all="ignore"):
                        found[:, some] = fn(*[c[place] for c in columns])
            keys = [table.column(c).take(pa.array(starts)).combine_chunks() for c in by]
            values = [pa.array(x, from_pandas=True).cast(pa.int64()) if t == "long" else pa.array(x, from_pandas=True) for x, t in zip(found, out.values())]
            yield from pa.table([*keys, *values], names=[*by, *out]).to_batches()

    placed = rows.select(*used).repartition(*by).sortWithinPartitions(*by, *order)
    return placed.mapInArrow(run, schema)


def best_first(relevance: str, item: str) -> list:
    return [F.desc_nulls_last(relevance), F.asc_nulls_first(item)]
