"""BM25 over a kept index of posting blocks, with exact threshold pruning.

Documents are dealt to blocks. A row of the index is the part of one word's postings that lies in one block, with the pairs (tf, dl)
that no other entry beats in both: the largest gain in the block follows from them for any k1, b and average length. Rows are
written block by block by the task that reads the documents: building an index shuffles nothing.

A search first reads these bounds alone, no entry. Per query and block they add up to a score that no document of the block passes.
The blocks with the best bounds are scored first; what the k-th best document has there is the threshold, and only
blocks whose bound reaches it are read after that. Every step is a sum in the tasks of one block; no (query, document) pair is shuffled
but the k best of a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tetrarank.constants import BM25_B, BM25_K1
from tetrarank.operators import bm25
from tetrarank.operators.blocks import DECIMALS, _best
from tetrarank.operators.runs import binary, byte_runs, byte_table, counted, firsts, ranges, slices
from tetrarank.operators.scale import checkpoint_dir, shared_path, top_k

BLOCK_DOCS, BLOCK_BYTES = 2048, 16 << 20
#: Blocks of a query that are scored before there is a threshold.
SEEDS = 2
#: An index of fewer blocks is scored in one pass: looking at bounds first would take longer than the blocks themselves.
PRUNE_FROM = 64
#: Distinct words of queries that the driver and a task hold at once (some 100 bytes each); more queries are cut into sets.
QUERY_TERMS = 200_000
#: Blocks and queries up to which their numbers are broadcast (some 20 bytes each).
BROADCAST_ROWS = 1_000_000
#: No index is put in order any more, however large its documents; kept for those who set it.
UNSORTED_BYTES = 64 << 20

ROWS = "term string, block bigint, size int, words bigint, tops binary, entries binary"
#: A word in a document: the document's place in its block, and how often. What is known of the document lies once in the block's row without word.
ENTRY = np.dtype([("at", "<u2"), ("tf", "<i4")])
DOC = np.dtype([("id", "<i8"), ("dl", "<i4")])
TOP = np.dtype([("tf", "<i4"), ("dl", "<i4")])
#: Runs of a-z and 0-9 in text that is lower case already.
TOKENS = byte_table((0x30, 0x39), (0x61, 0x7A))


@dataclass(frozen=True)
class PostingIndex:
    """Rows as in `ROWS`: one per word and block, and one without word per block (its documents and their words)."""

    rows: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> PostingIndex:
        return PostingIndex(spark.read.schema(ROWS).parquet(path))

    @property
    def terms(self) -> DataFrame:
        return self.rows.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("size").alias("df"))

    @property
    def stats(self) -> DataFrame:
        return self.rows.where(F.col("term").isNull()).agg(F.sum("size").alias("n_docs"), (F.sum("words") / F.sum("size")).alias("avgdl"))


def best_pairs(group: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """Positions of the entries of each group (ascending numbers) that no other one beats in both tf (more) and dl (less), by group."""
    order = np.lexsort((-tf, dl, group))
    height = group[order] * (int(tf.max(initial=0)) + 1) + tf[order]
    before = np.append(-1, np.maximum.accumulate(height)[:-1])
    new = firsts(group[order])
    better = height > before
    better[new] = True
    return order[better]


def _rows(block_docs: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in ROWS.split(", ")]
        for batch in slices(batches, 1, BLOCK_BYTES, block_docs):
            words, row = byte_runs(batch.column(1), TOKENS)
            lengths = np.bincount(row, minlength=batch.num_rows).astype(np.int32)
            ids = batch.column(0).to_numpy()
            known = np.empty(batch.num_rows, DOC)
            known["id"], known["dl"] = ids, lengths
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.array([block]), pa.array([batch.num_rows], pa.int32()), pa.array([int(np.maximum(lengths, 1).sum())]),
                 pa.nulls(1, pa.binary()), pa.array([known.tobytes()], pa.binary())], names=names)
            if len(words):
                coded = words.dictionary_encode()
                pairs, tf = counted(coded.indices.to_numpy().astype(np.int64) * batch.num_rows + row)
                term, at = pairs // batch.num_rows, pairs % batch.num_rows
                first = firsts(term)
                sizes = np.diff(np.append(first, len(term)))
                number = np.repeat(np.arange(len(first)), sizes)
                entries = np.empty(len(pairs), ENTRY)
                entries["at"], entries["tf"] = at, tf
                best = best_pairs(number, tf, lengths[at].astype(np.int64))
                tops = np.empty(len(best), TOP)
                tops["tf"], tops["dl"] = tf[best], lengths[at[best]]
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array(np.full(len(first), block)), pa.array(sizes.astype(np.int32)),
                     pa.nulls(len(first), pa.int64()), binary(tops.view(np.uint8), np.bincount(number[best]) * TOP.itemsize),
                     binary(entries.view(np.uint8), sizes * ENTRY.itemsize)], names=names)
            block += 1

    return run


def build_index(docs: DataFrame, doc_id: str, text: Column, path: str | None = None, block_docs: int = BLOCK_DOCS) -> PostingIndex:
    """Index the words (a-z and 0-9, lower case) of a text column at a path, or in the shared folder. Ids are whole numbers.

    A document without words counts with length one, so it still weighs on the average length.
    """
    if not 0 < block_docs <= 1 << 16:
        raise ValueError(f"a block has 1 to {1 << 16} documents")
    spark = docs.sparkSession
    path = path or shared_path(spark, "postings")
    found = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lower(text).cast("binary").alias("text")).mapInArrow(_rows(block_docs), ROWS)
    found.write.option("compression", "zstd").parquet(path)
    return PostingIndex.read(spark, path)


@dataclass(frozen=True)
class Plan:
    """What tasks need of the queries: numbers of the words, and (query, word, weight) entries by query."""

    numbers: dict[str, int]
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    k1: float
    b: float
    avgdl: float
    k: int

    def gain(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * dl / self.avgdl))


def _bounds(plan: Plan) -> Callable:
    """(term, tops) of a block to (q, block, bound): no document of the block scores more."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        number = np.array([plan.numbers[t] for t in rows.column("term").to_pylist()])
        lists = rows.column("tops").to_pylist()
        tops = np.frombuffer(b"".join(lists), TOP)
        start = np.append(0, np.cumsum([len(x) // TOP.itemsize for x in lists]))[:-1]
        most = np.zeros(len(plan.numbers))
        most[number] = np.maximum.reduceat(plan.gain(tops["tf"].astype(float), tops["dl"].astype(float)), start)
        there = np.zeros(len(plan.numbers), bool)
        there[number] = True
        queries = int(plan.query[-1]) + 1
        bound = np.bincount(plan.query, weights=np.maximum(plan.weight, 0.0) * most[plan.term], minlength=queries)
        hit = np.flatnonzero(np.bincount(plan.query, weights=there[plan.term], minlength=queries))
        yield pa.RecordBatch.from_pydict({"q": pa.array(hit.astype(np.int32)), "block": pa.array(np.full(len(hit), key[0].as_py())), "bound": pa.array(bound[hit])})

    return run


def _scores(plan: Plan) -> Callable:
    """Rows (term, entries) of a block, with the one of its documents, and the queries asked of it (q) to the k best documents of each."""
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        worded = pc.is_valid(rows.column("term"))
        docs, rows = rows.filter(pc.invert(worded)), rows.filter(worded)
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        docs = np.frombuffer(docs.column("entries")[0].as_py(), DOC)
        ids, width = docs["id"].astype(np.int64), len(docs)
        lists = rows.column("entries").to_pylist()
        entries = np.frombuffer(b"".join(lists), ENTRY)
        ends = np.append(0, np.cumsum([len(x) // ENTRY.itemsize for x in lists]))
        start, size = np.zeros(len(plan.numbers), np.int64), np.zeros(len(plan.numbers), np.int64)
        number = [plan.numbers[t] for t in rows.column("term").to_pylist()]
        start[number], size[number] = ends[:-1], np.diff(ends)
        at = entries["at"].astype(np.int64)
        gain = plan.gain(entries["tf"].astype(float), docs["dl"][at].astype(float))
        head = np.searchsorted(plan.query, np.arange(int(plan.query[-1]) + 2))
        found = []
        for q in np.sort(asked.column("q").to_numpy()):
            own = slice(head[q], head[q + 1])
            some = ranges(start[plan.term[own]], size[plan.term[own]])
            sums = np.bincount(at[some], weights=np.repeat(plan.weight[own], size[plan.term[own]]) * gain[some], minlength=width)
            scores = np.full((1, width), -np.inf)
            scores[0, at[some]] = np.round(sums[at[some]], DECIMALS) + 0.0
            _, i = _best(scores, ids, plan.k)
            found.append((np.full(len(i), q), ids[i], scores[0, i]))
        q, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(q, pa.int32()), pa.array(doc), pa.array(score)], schema=schema)

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def search(index: PostingIndex, queries: DataFrame, k: int, *, query_id: str = "query_id", text: str = "text", k1: float = BM25_K1, b: float = BM25_B,
           negative: str = "keep", prune_from: int = PRUNE_FROM, report: dict | None = None) -> DataFrame:
    """k best documents per query: query_id, doc_id, score, the same rows as `bm25.search` without filters.

    `report` receives how many (query, block) pairs there are and how many were read.
    """
    rule = (k, k1, b, negative, prune_from, report)
    asked = bm25.query_terms(queries, query_id, text)
    checkpoint_dir(queries.sparkSession)
    head = asked.limit(QUERY_TERMS + 1).toArrow()
    if head.num_rows <= QUERY_TERMS:
        return _search_set(index, head, asked, *rule)
    asked = asked.checkpoint()
    sets = -(-2 * asked.count() // QUERY_TERMS)
    parts = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i) for i in range(sets)]
    out = [_search_set(index, p.toArrow(), p, *rule) for p in parts]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


def _search_set(index: PostingIndex, asked: pa.Table, source: DataFrame, k: int, k1: float, b: float, negative: str, prune_from: int,
                report: dict | None) -> DataFrame:
    spark = source.sparkSession
    id_type = source.schema["query_id"].dataType.simpleString()
    if not asked.num_rows:
        return spark.createDataFrame([], f"query_id {id_type}, doc_id bigint, score double")
    asked = asked.combine_chunks().sort_by([("query_id", "ascending"), ("term", "ascending")])
    names = asked.column("query_id").combine_chunks().dictionary_encode()
    words = sorted(set(asked.column("term").to_pylist()))
    numbers = {t: i for i, t in enumerate(words)}
    vocabulary = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array([*words, None], pa.string())})).withColumnRenamed("term", "__term"))
    known = index.rows.join(vocabulary, F.col("term").eqNullSafe(F.col("__term"))).drop("__term")
    n_docs = total = blocks = 0
    df = np.zeros(len(words))
    for term, docs, n, rows in known.groupBy("term").agg(F.sum("size"), F.sum("words"), F.count(F.lit(1))).collect():  # a row per word of the queries
        if term is None:
            n_docs, total, blocks = docs, n, rows
        else:
            df[numbers[term]] = docs
    weight = np.array([math.log((n_docs - x + 0.5) / (x + 0.5)) if x else 0.0 for x in df])
    if negative == "floor_avg":
        weight[weight < 0] = 0.25 * (index.terms.agg(F.avg(bm25.idf(F.lit(n_docs), F.col("df")))).first()[0] or 0.0)
    elif negative != "keep":
        raise ValueError(f"unknown idf rule {negative!r}")
    term = np.array([numbers[t] for t in asked.column("term").to_pylist()])
    plan = Plan(numbers, names.indices.to_numpy().astype(np.int64), term, weight[term] * asked.column("qtf").to_numpy(), k1, b, total / max(n_docs, 1), k)

    number = np.arange(len(names.dictionary))
    if blocks < prune_from:
        score, every = _scores(plan), pa.table({"q": pa.array(number, pa.int32())})
        found = known.select("block", "term", "entries").groupBy("block").applyInArrow(lambda table: score(table, every), "q int, doc_id bigint, score double")
    else:
        found = _pruned(known, len(number), plan, report)
    hits = top_k(found, ["q"], [F.desc("score"), F.col("doc_id")], k)
    named = spark.createDataFrame(pa.table({"q": pa.array(number, pa.int32()), "query_id": names.dictionary}), f"q int, query_id {id_type}")
    return hits.join(F.broadcast(named), "q").select("query_id", "doc_id", "score")


def _pruned(rows: DataFrame, queries: int, plan: Plan, report: dict | None) -> DataFrame:
    """The best documents of the blocks with the best bounds, and of those whose bound reaches the k-th best of them."""
    bounds = rows.where(F.col("term").isNotNull()).select("block", "term", "tops").groupBy("block").applyInArrow(_bounds(plan), "q int, block bigint, bound double").checkpoint()
    order = W.partitionBy("q").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS).drop("r")
    first = _read(rows, seeds, SEEDS * queries, plan).checkpoint()
    best = first.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") == plan.k).select("q", F.col("score").alias("least"))
    rest = bounds.join(_small(seeds.select("q", "block"), SEEDS * queries), ["q", "block"], "left_anti").join(_small(best, queries), "q", "left").where(
        F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2.0 * 10.0 ** -DECIMALS)).select("q", "block", "bound").checkpoint()
    left = rest.count()
    if report is not None:
        report.update(pairs=report.get("pairs", 0) + bounds.count(), read=report.get("read", 0) + seeds.count() + left)
    return first.unionByName(_read(rows, rest, left, plan)) if left else first


def _read(rows: DataFrame, pairs: DataFrame, count: int, plan: Plan) -> DataFrame:
    """Scores of the asked (q, block) pairs; entries of other blocks are not moved."""
    wanted = rows.select("block", "term", "entries").join(_small(pairs.select("block").distinct(), count), "block", "left_semi")
    return wanted.groupBy("block").cogroup(pairs.select("block", "q").groupBy("block")).applyInArrow(_scores(plan), "q int, doc_id bigint, score double")
