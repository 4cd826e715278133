"""BM25 over token tables: corpus statistics, postings and batch search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrarank.constants import BM25_B, BM25_K1
from tetrarank.functions import text as tx
from tetrarank.operators import items
from tetrarank.operators.blocks import top_k_scores
from tetrarank.operators.scale import checkpoint_dir, top_k

PAIRS = 4_000_000
#: Tokens of documents that are counted at once.
TOKENS = 250_000


@dataclass(frozen=True)
class BM25Index:
    """docs(doc_id, dl, terms, tfs), terms(term, df), stats(n_docs, avgdl): three tables, nothing else.

    A document's distinct words and their counts lie in its own row, so neither building nor searching shuffles postings.
    """

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl: a row per distinct word of a document."""
        pairs = self.docs.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return pairs.select("doc_id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), "dl")

    def write(self, path: str, partitions: int | None = None) -> None:
        docs = self.docs.repartition(partitions, "doc_id") if partitions else self.docs
        docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    def materialized(self) -> BM25Index:
        """Documents stored in the checkpoint folder, so that the searches that follow share one pass over the texts."""
        checkpoint_dir(self.docs.sparkSession)
        return index_of(self.docs.checkpoint())

    @staticmethod
    def read(spark: SparkSession, path: str) -> BM25Index:
        return BM25Index(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "terms", "stats")])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens) to (doc_id, dl, terms, tfs), counted within each row for a bounded number of tokens at once."""
    for whole in batches:
        lengths = pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < whole.num_rows:  # at most TOKENS tokens; a longer document alone
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS, side="right")))
            batch = whole.slice(start, stop - start)
            tokens, sizes = batch.column(1), lengths[start:stop]
            codes = tokens.flatten().dictionary_encode()
            width = max(1, len(codes.dictionary))
            pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * width).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(offsets), codes.dictionary.take(pa.array(pairs % width)))
            tfs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), terms, tfs], names=["doc_id", "dl", "terms", "tfs"])
            start = stop


def build_index(docs: DataFrame, doc_id: str, tokens: Column) -> BM25Index:
    """Index documents whose token array is given as a column expression.

    A document without tokens counts with length one, so it still weighs on the average length.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")).mapInArrow(
        _count_words, f"doc_id {kind}, dl bigint, terms array<string>, tfs array<bigint>")
    return index_of(counted)


def index_of(docs: DataFrame) -> BM25Index:
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.greatest("dl", F.lit(1))).alias("avgdl"))
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return BM25Index(docs, df, stats)


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5))


def term_weights(index: BM25Index, negative: str = "keep") -> DataFrame:
    """terms with idf. Negative values are kept, or floored at a quarter of the average idf."""
    n = index.stats.select("n_docs").scalar()
    weighted = index.terms.withColumn("idf", idf(n, F.col("df")))
    if negative == "keep":
        return weighted
    if negative == "floor_avg":
        floor = index.terms.agg((F.avg(idf(n, F.col("df"))) * 0.25).alias("x")).scalar()
        return weighted.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
    raise ValueError(f"unknown idf rule {negative!r}")


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term, qtf; repeated words of a query count as often as they occur."""
    return (queries.select(F.col(query_id).alias("query_id"), F.explode(tx.tokens(F.col(text))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _ragged(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    rows = np.repeat(np.arange(len(array)), pc.list_value_length(array).to_numpy(zero_copy_only=False))
    return array.flatten(), rows


def _score_matrix(queries: pa.Table, docs: pa.Table) -> np.ndarray:
    """Sum over shared terms of query weight times document gain; -inf where no term is shared.

    A sparse product: the documents' entries are sorted by term, and each query term meets just those of its own.
    """
    words, q_row = _ragged(queries.column("terms"))
    weights, _ = _ragged(queries.column("weights"))
    doc_words, d_row = _ragged(docs.column("terms"))
    gains, _ = _ragged(docs.column("gains"))
    vocabulary = pc.unique(words)
    q_term = pc.index_in(words, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    d_term = pc.fill_null(pc.index_in(doc_words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.flatnonzero(d_term >= 0)
    known = known[np.argsort(d_term[known], kind="stable")]
    gain, row = gains.to_numpy(zero_copy_only=False)[known], d_row[known]
    bounds = np.searchsorted(d_term[known], np.arange(len(vocabulary) + 1))
    weight = weights.to_numpy(zero_copy_only=False)
    width = docs.num_rows
    scores, shared = np.zeros(queries.num_rows * width), np.zeros(queries.num_rows * width, bool)
    sizes = (bounds[1:] - bounds[:-1])[q_term]
    ends = np.cumsum(sizes)
    first = 0
    while first < len(q_term):  # a bounded number of products at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        n = sizes[first:last]
        at = np.repeat(bounds[q_term[first:last]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(q_row[first:last], n) * width + row[at]
        scores += np.bincount(cell, weights=np.repeat(weight[first:last], n) * gain[at], minlength=len(scores))
        shared[cell] = True
        first = last
    return np.where(shared, scores, -np.inf).reshape(queries.num_rows, width)


def search(index: BM25Index, queries: DataFrame, k: int, *, query_id: str = "query_id", text: str = "text",
           k1: float = BM25_K1, b: float = BM25_B, negative: str = "keep", doc_filter: DataFrame | None = None,
           filters: DataFrame | None = None, meta: DataFrame | None = None, filter_mode: str = "pre", oversample: int = 5,
           broadcast_rows: int = 5_000) -> DataFrame:
    """k best documents per query: query_id, doc_id, score.

    Scores of a block of documents are one sparse product with the block of queries, so a frequent word adds no row
    per (query, document) pair to a shuffle. `doc_filter` holds allowed doc_ids for all queries; `filters` has a row
    of conditions per query (see `items.FILTERS`), met by the columns of `meta` (doc_id, ...). With filter_mode="post" both
    apply after a cut at k * oversample, and fewer than k may remain.
    """
    asked = query_terms(queries, query_id, text)
    weighted = asked.join(term_weights(index, negative), "term").withColumn("weight", F.col("idf") * F.col("qtf"))
    packed = weighted.groupBy("query_id").agg(
        F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    avgdl = index.stats.select("avgdl").scalar()
    gains = F.transform("tfs", lambda tf: tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("__avgdl"))))
    documents = index.docs.where(F.size("terms") > 0).withColumn("__avgdl", avgdl).select("doc_id", "terms", gains.alias("gains"))
    allowed = None if doc_filter is None else doc_filter.select("doc_id").distinct()
    post = filter_mode == "post"
    first, keep = (k * max(1, oversample) if post else k), None
    if not post:
        if allowed is not None:
            documents = documents.join(allowed, "doc_id", "left_semi")
        if filters is not None:
            packed, documents, keep = items.with_filters(packed, documents, filters, meta, "query_id", "doc_id")
    hits = top_k_scores(packed, documents, _score_matrix, first, query_id="query_id", item_id="doc_id", keep=keep, broadcast_rows=broadcast_rows)
    if post:
        if allowed is not None:
            hits = hits.join(allowed, "doc_id", "left_semi")
        if filters is not None:
            hits = items.passing(hits, filters, meta, "query_id", "doc_id")
        hits = top_k(hits, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
    return hits.select("query_id", "doc_id", "score")


def index_report(index: BM25Index, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """One row of artifact statistics."""
    return index.stats.select("n_docs", "avgdl", F.lit(k1).alias("k1"), F.lit(b).alias("b"))
