"""Exact scoring of every query against every item, block by block, keeping k hits per query.

A block of queries and a block of items are scored as one numpy matrix and only the k best hits per
query leave the task, so the full query-item matrix is never written, shuffled or collected.

Two physical paths give the same rows:
* a query side under checked row and byte bounds is broadcast and items stream past it in Arrow batches;
* a larger query side is laid out with the items on a grid of (query block, item block) cells whose
  sizes are set from counts, one task per cell. A large grid is met in turns, so its copies of the rows are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrarank.operators.scale import drop_unused, stored, top_k

DECIMALS = 6
#: Queries and items of a block: their scores are one matrix.
QUERY_ROWS, ITEM_ROWS = 400, 2_000
BROADCAST_BYTES = 64 << 20
ITEMS_PER_QUERY = 10
#: Bytes that go to the cells at once, about; where there are more, blocks of items take turns.
MOVED_BYTES = 4 << 30


def list_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths as a float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, item) of the k best finite scores per row; ties by smaller id."""
    width = scores.shape[1]
    if width > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        q, i = np.nonzero((scores >= edge) & np.isfinite(scores))
    else:
        q, i = np.nonzero(np.isfinite(scores))
    order = np.lexsort((ids[i], -scores[q, i], q))
    q, i = q[order], i[order]
    starts = np.searchsorted(q, np.arange(scores.shape[0]))
    keep = np.arange(len(q)) - starts[q] < k
    return q[keep], i[keep]


def _merge(best: tuple | None, q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    if best is not None:
        q, s, ids = (np.concatenate(pair) for pair in zip(best, (q, s, ids)))
    order = np.lexsort((ids, -s, q))
    q, s, ids = q[order], s[order], ids[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - start < k
    return q[keep], s[keep], ids[keep]


class Scorer:
    """A scorer that prepares either side once per block; `fn(queries, items)` gives the matrix of two prepared blocks."""

    #: Items of a block, and whether `hits` has bounds of its own to start from.
    item_rows, bounded = ITEM_ROWS, False

    def __init__(self, fn: Callable | None = None):
        self.fn = fn

    def left(self, queries: pa.Table):
        return queries

    def right(self, items: pa.Table):
        return items

    def scores(self, left, right) -> np.ndarray:
        return self.fn(left, right)

    def reaching(self, left, right, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all pairs whose score is not below `least` of the query."""
        scores = self.scores(left, right)
        at = np.flatnonzero(scores >= least[:, None])
        return at // scores.shape[1], at % scores.shape[1], scores.ravel()[at]

    def hits(self, left, right, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What `reaching` gives, in pieces; pairs that cannot be among the k best of the query may be missing."""
        yield self.reaching(left, right, least)

    def __call__(self, queries: pa.Table, items: pa.Table) -> np.ndarray:
        return self.scores(self.left(queries), self.right(items))


class Running:
    """The k best hits of each of n queries. What cannot reach the k-th best of its query so far, or `least`, is not looked at again."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.n, self.k, self.best, self.pending, self.size = n, k, None, [], 0
        self.edge = np.full(n, -np.inf) if least is None else np.where(np.isnan(least), -np.inf, least)

    def add(self, scorer: Scorer, left, right, ids: np.ndarray, rows: np.ndarray | None = None, kept: np.ndarray | None = None) -> None:
        """A block of items for all queries, or for those at `rows`; `kept` marks pairs that may be hits."""
        edge = self.edge if rows is None else self.edge[rows]
        started = np.isfinite(edge).all()
        if kept is None and (started or scorer.bounded):
            for q, i, s in scorer.hits(left, right, edge - 10.0 ** -DECIMALS, self.k):
                s = np.round(s, DECIMALS) + 0.0
                good = np.isfinite(s)
                self._put(q[good], s[good], ids[i[good]], rows)
        else:
            scores = np.round(scorer.scores(left, right), DECIMALS) + 0.0
            if kept is not None:
                scores = np.where(kept, scores, -np.inf)
            q, i = _best(scores, ids, self.k)
            self._put(q, scores[q, i], ids[i], rows)
        if not started and rows is None:
            self.merged()

    def _put(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray, rows: np.ndarray | None) -> None:
        self.pending.append((q if rows is None else rows[q], s, ids))
        self.size += len(q)
        if self.size > 2 * self.n * self.k:
            self.merged()

    def merged(self) -> tuple | None:
        """(query, score, id) of the hits so far, by query, best first."""
        if self.pending:
            q, s, ids = (np.concatenate(x) for x in zip(*self.pending, strict=True))
            self.best, self.pending, self.size = _merge(self.best, q, s, ids, self.k), [], 0
            q, s, _ = self.best
            full = np.flatnonzero(np.bincount(q, minlength=self.n) == self.k)
            last = np.searchsorted(q, full, side="right") - 1
            self.edge[full] = np.maximum(self.edge[full], s[last])
        return self.best


def _score_batches(queries: pa.Table, batches: Iterator[pa.Table], scorer: Callable, item_id: str, k: int,
                   keep: Callable | None) -> tuple | None:
    """Running k best over item batches; a block of queries meets a block of items, and its hits are kept apart from other blocks'."""
    scorer = scorer if isinstance(scorer, Scorer) else Scorer(scorer)
    parts = [queries.slice(s, QUERY_ROWS) for s in range(0, queries.num_rows, QUERY_ROWS)]
    lefts, running = [scorer.left(p) for p in parts], [Running(p.num_rows, k) for p in parts]
    for batch in _gathered(batches, scorer.item_rows) if scorer.bounded else batches:
        for start in range(0, batch.num_rows, scorer.item_rows):
            items = batch.slice(start, scorer.item_rows)
            right, ids = scorer.right(items), items.column(item_id).to_numpy()
            for part, left, run in zip(parts, lefts, running, strict=True):
                run.add(scorer, left, right, ids, kept=None if keep is None else keep(part, items))
    found = [(j, hits) for j, hits in enumerate(run.merged() for run in running) if hits is not None]
    if not found:
        return None
    return tuple(np.concatenate(x) for x in zip(*[(q + j * QUERY_ROWS, s, ids) for j, (q, s, ids) in found], strict=True))


def _gathered(batches: Iterator[pa.Table], most: int) -> Iterator[pa.Table]:
    """Small batches put together, up to about so many rows."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.concat_tables(held)
            held = []
    if held:
        yield pa.concat_tables(held)


def top_k_scores(queries: DataFrame, items: DataFrame, scorer: Callable, k: int, *, query_id: str, item_id: str,
                 score: str = "score", keep: Callable | None = None, broadcast_rows: int = 5_000,
                 block_rows: int = 20_000, item_rows: int | None = None) -> DataFrame:
    """k best items per query: columns query_id, item_id, score (rounded to 6 places).

    `scorer(queries, items)` is a matrix of scores, -inf for "no hit", or a `Scorer`. `keep(queries, items)` may return a boolean
    matrix that removes pairs before the cut.
    """
    q_type, i_type = queries.schema[query_id].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField(query_id, q_type), T.StructField(item_id, i_type),
                           T.StructField(score, T.DoubleType())])
    arrow_schema = pa.schema([(query_id, _arrow(q_type)), (item_id, _arrow(i_type)), (score, pa.float64())])
    order = [F.desc(score), F.col(item_id)]

    def rows(table: pa.Table, best: tuple | None) -> pa.Table:
        if best is None:
            return arrow_schema.empty_table()
        q, s, ids = best
        return pa.table([table.column(query_id).take(pa.array(q)), pa.array(ids), pa.array(s)],
                        names=arrow_schema.names).cast(arrow_schema)

    head = queries.limit(broadcast_rows + 1).toArrow()
    if head.num_rows <= broadcast_rows and head.nbytes <= BROADCAST_BYTES:
        shared = queries.sparkSession.sparkContext.broadcast(head)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = (pa.Table.from_batches([b]) for b in batches)
            yield from rows(shared.value, _score_batches(shared.value, tables, scorer, item_id, k, keep)).to_batches()

        return top_k(items.mapInArrow(stream, schema), [query_id], order, k)

    row_bytes = max(1, head.nbytes // max(1, head.num_rows))
    block_rows = max(1, min(block_rows, BROADCAST_BYTES // row_bytes))
    # A cell scores its items in slices, so it can hold many more of them than queries, and a query goes to fewer cells.
    item_rows = item_rows or max(block_rows, min(ITEMS_PER_QUERY * block_rows, 4 * BROADCAST_BYTES // row_bytes))
    n_queries, n_items = queries.count(), items.count()
    q_blocks, i_blocks = _grid(n_queries, n_items, block_rows, item_rows, queries.sparkSession.sparkContext.defaultParallelism)
    rounds = min(i_blocks, math.ceil(row_bytes * (n_queries * i_blocks + n_items * q_blocks) / MOVED_BYTES)) or 1
    if rounds > 1:
        queries, items = stored(queries, "queries"), stored(items, "items")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return rows(left, _score_batches(left, iter([right]), scorer, item_id, k, keep))

    def met(turn: int) -> DataFrame:
        """Hits of every `rounds`-th block of items."""
        q_cells = (queries.withColumn("__qb", F.pmod(F.xxhash64(query_id), F.lit(q_blocks)))
                   .withColumn("__ib", F.explode(_block_ids(i_blocks, turn, rounds))))
        i_cells = (items.withColumn("__ib", F.pmod(F.xxhash64(item_id), F.lit(i_blocks))).where(F.pmod("__ib", F.lit(rounds)) == turn)
                   .withColumn("__qb", F.explode(_block_ids(q_blocks))))
        return (q_cells.groupBy("__qb", "__ib").cogroup(i_cells.groupBy("__qb", "__ib"))
                .applyInArrow(cell, schema))

    if rounds == 1:
        return top_k(met(0), [query_id], order, k)
    hits = None
    for turn in range(rounds):
        found = met(turn) if hits is None else hits.unionByName(met(turn))
        hits = stored(top_k(found, [query_id], order, k), "hits")
        drop_unused(queries.sparkSession)
    return hits


def _grid(queries: int, items: int, block_rows: int, item_rows: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of items: of bounded size, and about two cells per core, with smaller blocks of queries first."""
    q_blocks, i_blocks = math.ceil(queries / block_rows), max(1, math.ceil(items / item_rows))
    q_blocks = max(q_blocks, min(math.ceil(2 * cores / i_blocks), queries // (5 * QUERY_ROWS)))
    return q_blocks, max(i_blocks, min(math.ceil(2 * cores / max(1, q_blocks)), items // (ITEMS_PER_QUERY * ITEM_ROWS)))


def _block_ids(n: int, first: int = 0, step: int = 1):
    return F.sequence(F.lit(first).cast("long"), F.lit(n - 1).cast("long"), F.lit(step).cast("long"))


def _arrow(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(data_type)


def block_pairs(df: DataFrame, by: list[str], row_id: str, fn: Callable, schema: str, *,
                block_rows: int = 2_000, carry: list[str]) -> DataFrame:
    """Apply `fn(left, right)` to every pair of row blocks within each group.

    Groups are cut into blocks of about `block_rows` rows by hash, and each cell (a, b) of blocks is one
    task, so a group of any size is spread out and only what `fn` returns leaves a cell.
    """
    counts = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("long").alias("__nb"))
    keyed = df.select(*by, row_id, *[c for c in carry if c not in by and c != row_id])
    with_blocks = keyed.join(counts, by).withColumn("__block", F.pmod(F.xxhash64(row_id), F.col("__nb")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__nb") - 1))
    # Fresh column ids on both sides: cogrouping a frame with itself is ambiguous otherwise.
    names = keyed.columns
    left = with_blocks.select(*[F.col(c).alias(c) for c in names], F.col("__block").alias("__a"), others.alias("__b"))
    right = with_blocks.select(*[F.col(c).alias(c) for c in names], others.alias("__a"), F.col("__block").alias("__b"))
    cell = [*by, "__a", "__b"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(fn, schema)
