"""Ranked lexical search over a kept index: short lists term at a time, long lists document at a time.

Index: documents are dealt to blocks of bounded rows and bytes. A block has a row per term with the places and counts of its
documents (ascending doc_id), and one row with the ids and lengths of all its documents. It is built in one pass without a
shuffle, holds nothing of any query, and serves any number of searches.

Search: a query's terms select rows of the index; the rows of a block meet in one task. There the hybrid evaluation runs, query by
query. Lists of at most `SHORT` documents are summed term at a time into accumulators. These are then one more list, with its
own bounds, beside the long lists, which are read document at a time: windows of documents in ascending order, skipped where the
lists' bounds in the window cannot reach the k-th best score; in a window the lists that could not reach it by themselves are only
looked up for documents that the others leave in the race (by binary search). A first search over one in 32 blocks gives every
query a score that its k-th best reaches for sure, so other blocks start with that bound. Bounds are exact sums of whole numbers:
no document is lost.

Cases: null and empty texts have no terms and are never found. Null doc_ids come first among equal scores, equal ids (repeated
rows) are found as often as they occur. Items with the same id are one item with all their terms; items without terms or hits have
no rows. Empty tables give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tetrarank.llm.common import new_path, stored
from tetrarank.llm.terms import WORDS, arrays, counted, slices, terms

BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: A list of at most so many documents of a block is summed into the accumulators.
SHORT = 64
WINDOW = 256
#: Distinct (item, term) rows that one search holds in the driver and in its tasks (some 100 bytes each); more items are cut into sets.
QUERY_TERMS = 200_000

INDEX = "block bigint, term binary, size int, places array<int>, counts array<int>, ids array<bigint>, lengths array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the rows of the index; block numbers are made from the task and a running number."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in slices(batches, 1, BLOCK_BYTES, BLOCK_ROWS):
        batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
        words, row = terms(batch.column(1), WORDS)
        lengths = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
        yield _index_rows(block, [None], [0], [[]], [[]], [batch.column(0).to_pylist()], [lengths])
        if len(words):
            coded = words.dictionary_encode()
            pairs, n = counted(coded.indices.to_numpy().astype(np.int64) * batch.num_rows + row)
            code = pairs // batch.num_rows
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            code = code[first]
            offsets = pa.array(np.append(first, len(pairs)).astype(np.int32))
            places, counts = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % batch.num_rows, n))
            none = pa.nulls(len(code), pa.list_(pa.int64()))
            yield _index_rows(block, coded.dictionary.take(pa.array(code)).cast(pa.binary()), np.diff(np.append(first, len(pairs))), places, counts, none, none)
        block += 1


def _index_rows(block: int, term, size, places, counts, ids, lengths) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "term": pa.binary(), "size": pa.int32(), "places": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()),
             "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
    values = [[block] * len(term), term, size, places, counts, ids, lengths]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, kinds.values(), strict=True)], names=list(kinds))


@dataclass(frozen=True)
class LexicalIndex:
    """Rows as in `INDEX`: per block one without term (ids, lengths), and one per term (places, counts)."""

    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.rows.where(F.col("term").isNotNull())

    @property
    def blocks(self) -> DataFrame:
        return self.rows.where(F.col("term").isNull())

    def size(self) -> tuple[int, int]:
        """(documents with a term, all terms with repeats)."""
        long = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)
        n, total = self.blocks.agg(F.sum(F.size(F.filter("lengths", lambda x: x > 0))), F.sum(long)).first()
        return n or 0, total or 0


def build_index(docs: DataFrame, path: str | None = None) -> LexicalIndex:
    """Index (doc_id, text) rows at a path, or in the shared folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "lexical-index")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_blocks, INDEX).write.option(
        "compression", "zstd").parquet(path)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(spark.read.schema(INDEX).parquet(path))


# --- one block --------------------------------------------------------------------------------------------------------


@dataclass
class List:
    """Places (ascending) and scores of the documents of one list, with the largest score of each window."""

    places: np.ndarray
    scores: np.ndarray
    cuts: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(places: np.ndarray, scores: np.ndarray, edges: np.ndarray) -> List:
        cuts = np.searchsorted(places, edges)
        bounds = np.zeros(len(edges) - 1, np.int64)
        some = np.flatnonzero(np.diff(cuts))
        if len(some):
            bounds[some] = np.maximum.reduceat(scores, cuts[some])
        return List(places, scores, cuts, bounds)


def edges_of(size: int) -> np.ndarray:
    return np.append(np.arange(0, size, WINDOW), size)


def hybrid_top(lists: list[tuple[List, int]], size: int, k: int, floor: int = 1, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best of `size` documents with a score of at least `floor`, equal scores by ascending place.

    `lists` are (list, weight) of one query. `seen` counts windows and those skipped.
    """
    edges = edges_of(size)
    sums = np.zeros(size, np.int64)
    for one, weight in lists:  # term at a time
        if len(one.places) <= SHORT:
            sums[one.places] += weight * one.scores
    touched = np.flatnonzero(sums)
    rest = [(List.of(touched, sums[touched], edges), 1)] + [(one, weight) for one, weight in lists if len(one.places) > SHORT]
    bounds = np.stack([weight * one.bounds for one, weight in rest])
    best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in np.flatnonzero(bounds.sum(axis=0) >= floor):  # document at a time, by windows
        if bounds[:, w].sum() < floor:
            continue
        if seen is not None:
            seen["windows"] = seen.get("windows", 0) + 1
        start, scores = edges[w], np.zeros(edges[w + 1] - edges[w], np.int64)
        order = np.argsort(bounds[:, w], kind="stable")
        open_ = np.cumsum(bounds[order, w])
        weak = int(np.searchsorted(open_, floor))  # lists that together stay under the floor
        for i in order[weak:]:
            one, weight = rest[i]
            a, b = one.cuts[w], one.cuts[w + 1]
            scores[one.places[a:b] - start] += weight * one.scores[a:b]
        left = np.flatnonzero(scores)
        for j in range(weak - 1, -1, -1):  # looked up for what is left only
            one, weight = rest[order[j]]
            left = left[scores[left] + open_[j] >= floor]
            a, b = one.cuts[w], one.cuts[w + 1]
            if a == b or not len(left):
                continue
            at = np.minimum(np.searchsorted(one.places[a:b], left + start), b - a - 1)
            hit = one.places[a:b][at] == left + start
            scores[left[hit]] += weight * one.scores[a:b][at[hit]]
        left = left[scores[left] >= floor]
        best_at, best = np.append(best_at, left + start), np.append(best, scores[left])
        if len(best) > k:
            keep = np.sort(np.lexsort((best_at, -best))[:k])
            best_at, best = best_at[keep], best[keep]
        if len(best) == k:
            floor = max(floor, int(best.min()))
    return best_at, best


@dataclass(frozen=True)
class Plan:
    """What a task needs of the queries: term -> number, weights of each item's terms, floors, and the size of the corpus."""

    numbers: dict[bytes, int]
    items: list[list[tuple[int, int]]]
    documents: int
    words: int
    k: int


def norms(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L per document."""
    top = int(lengths.max(initial=0))
    if 25 * top * documents < 1 << 62:
        return 75 + 25 * lengths * documents // max(words, 1)
    return np.array([75 + 25 * int(n) * documents // words for n in lengths], np.int64)


def _search_block(plan: Plan, floors: list[int]) -> Callable:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        head = pc.index(pc.is_null(rows.column("term")), True).as_py()
        ids = rows.column("ids")[head].values
        lengths = rows.column("lengths")[head].values.to_numpy()
        m, edges, lists = norms(lengths, plan.documents, plan.words), edges_of(len(lengths)), {}
        for i, term in enumerate(rows.column("term").to_pylist()):
            if term is not None:
                places, tf = (rows.column(c)[i].values.to_numpy().astype(np.int64) for c in ("places", "counts"))
                lists[plan.numbers[term]] = List.of(places, 1_000_000_000 * tf // (1000 * tf + 12 * m[places]), edges)
        item, at, score = [], [], []
        for q, weights in enumerate(plan.items):
            here = [(lists[t], w) for t, w in weights if t in lists]
            if here:
                places, scores = hybrid_top(here, len(lengths), plan.k, floors[q])
                item.append(np.full(len(places), q)), at.append(places), score.append(scores)
        if item:
            at = np.concatenate(at)
            yield arrays(len(at), item=np.concatenate(item).astype(np.int32), doc_id=ids.take(pa.array(at)), score=np.concatenate(score).astype(np.int64))

    return run


# --- search -----------------------------------------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, BLOCK_BYTES, 1 << 20):
        words, row = terms(batch.column(1), WORDS)
        if len(words):
            yield arrays(len(row), item_id=batch.column(0).take(pa.array(row)), term=words.cast(pa.binary()))


def _blocks_of(index: LexicalIndex, found: DataFrame, plan: Plan, floors: list[int], seeds: bool | None) -> DataFrame:
    """Hits (item number, doc_id, score) of all blocks, of the seed blocks, or of the others."""
    seed = F.pmod(F.xxhash64("block"), F.lit(32)) == 0
    rows = found.unionByName(index.blocks)
    rows = rows if seeds is None else rows.where(seed if seeds else ~seed)
    return rows.groupBy("block").applyInArrow(_search_block(plan, floors), "item int, doc_id bigint, score bigint")


def search(index: LexicalIndex, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 per item of (item_id, text)."""
    spark = items.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _item_terms, f"item_id {items.schema['item_id'].dataType.simpleString()}, term binary").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))
    asked = stored(asked, "lexical-items")
    sets = max(1, -(-2 * asked.count() // QUERY_TERMS))
    n, total = index.size()
    hits = None
    for number in range(sets):  # one, unless the items hold more terms than a task may keep
        some = asked if sets == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == number)
        part = _search_set(spark, index, some, n, total, k)
        hits = part if hits is None else hits.unionByName(part)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_set(spark: SparkSession, index: LexicalIndex, asked: DataFrame, documents: int, words: int, k: int) -> DataFrame:
    query = asked.orderBy("item_id", "term").toArrow()  # at most some QUERY_TERMS rows
    keys, names = query.column("term").to_pylist(), pc.unique(query.column("item_id"))
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    numbers = {t: i for i, t in enumerate(sorted(set(keys)))}
    vocabulary = spark.createDataFrame(pa.table({"term": pa.array(list(numbers), pa.binary())}))
    found = index.postings.join(F.broadcast(vocabulary), "term").select(*index.rows.columns)
    weight = [0] * len(numbers)
    for term, df in found.groupBy("term").agg(F.sum("size")).collect():
        weight[numbers[bytes(term)]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    item_of = {v: i for i, v in enumerate(names.to_pylist())}
    lists = [[] for _ in item_of]
    for item, term, repeats in zip(query.column("item_id").to_pylist(), keys, query.column("repeats").to_pylist(), strict=True):
        if weight[numbers[term]]:
            lists[item_of[item]].append((numbers[term], weight[numbers[term]] * repeats))
    plan, floors = Plan(numbers, lists, documents, words, k), [1] * len(lists)
    first = stored(_blocks_of(index, found, plan, floors, True), "lexical-seeds")
    best = W.partitionBy("item").orderBy(F.desc("score"))
    for item, score in first.select("item", "score", F.row_number().over(best).alias("r")).where(F.col("r") == k).select("item", "score").collect():
        floors[item] = score
    hits = first.unionByName(_blocks_of(index, found, plan, floors, False))
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int32()), "item_id": names}),
                                  f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return hits.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")


ORACLE = r"""
    WITH words AS (SELECT row, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                   FROM (SELECT row_number() OVER () AS row, doc_id,
                                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
    tfs AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY row, term),
    lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM tfs GROUP BY row),
    corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weights AS (SELECT item_id, term, count(*) * any_value(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT) AS w
                FROM asked JOIN dfs USING (term), corpus GROUP BY item_id, term),
    scores AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
               FROM weights JOIN tfs USING (term) JOIN lengths USING (row), corpus GROUP BY item_id, row),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
