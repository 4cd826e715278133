"""Exact nearest neighbours, norms and embedding checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.functions import vectors as vx
from tetrarank.functions.numeric import hash_uniform
from tetrarank.operators import items as item_tables
from tetrarank.operators.blocks import Scorer, list_matrix, top_k_scores
from tetrarank.operators.scale import top_k

#: Queries that meet in a cell where they are too many to be broadcast.
CELL_QUERIES = 60_000
#: Pairs of a block computed one by one; if more are in reach, the whole block is.
PAIRS = 200_000


class _Vectors(Scorer):
    """Scores of vectors. Pairs are first looked at in single precision; only those in reach, by a bound of its error, are computed in double."""

    def __init__(self, metric: str):
        super().__init__()
        self.metric = metric

    @staticmethod
    def unit(m: np.ndarray) -> np.ndarray:
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + vx.EPS)

    def left(self, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = list_matrix(queries.column("vector"))
        if self.metric == "l2":
            return q, np.hstack([2.0 * q, np.ones((len(q), 1))]).astype(np.float32), (q * q).sum(1)
        q = self.unit(q)
        return q, q.astype(np.float32), np.zeros(len(q))

    def right(self, items: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = list_matrix(items.column("vector"))
        if self.metric == "cosine":
            x = self.unit(x)
        square = (x * x).sum(1)
        return x, (np.hstack([x, -square[:, None]]) if self.metric == "l2" else x).astype(np.float32), square

    def scores(self, left: tuple, right: tuple) -> np.ndarray:
        (q, _, q2), (x, _, x2) = left, right
        if self.metric == "l2":
            return -np.maximum(q2[:, None] + x2[None, :] - 2.0 * (q @ x.T), 0.0)
        return q @ x.T

    def reaching(self, left: tuple, right: tuple, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (q, q_rough, q2), (x, x_rough, x2) = left, right
        # A sum of d rounded products is off by at most (d + 2) 2^-24 times the product of the lengths.
        lengths = np.linalg.norm(q_rough.astype(np.float64), axis=1) * np.sqrt((x_rough.astype(np.float64) ** 2).sum(1).max(initial=0.0))
        error = (q_rough.shape[1] + 8) * 1.2e-7 * lengths
        if not np.isfinite(error).all() or error.max(initial=0.0) > 1e18:
            return super().reaching(left, right, least)
        at = np.flatnonzero(q_rough @ x_rough.T >= (least + q2 - error)[:, None].astype(np.float32))
        if len(at) > PAIRS:
            return super().reaching(left, right, least)
        i, j = at // len(x), at % len(x)
        product = np.einsum("ij,ij->i", q[i], x[j])
        score = -np.maximum(q2[i] + x2[j] - 2.0 * product, 0.0) if self.metric == "l2" else product
        good = score >= least[i]
        return i[good], j[good], score[good]


def search(queries: DataFrame, items: DataFrame, k: int, *, metric: str = "cosine", query_id: str = "query_id",
           item_id: str = "item_id", vector: str = "vector", allowed: DataFrame | None = None, filters: DataFrame | None = None,
           meta: DataFrame | None = None, filter_mode: str = "pre", oversample: int = 5, broadcast_rows: int = 5_000) -> DataFrame:
    """k best items per query: query_id, item_id, score. Rows without a vector are left out.

    `ip` scores the unit query against items as stored, `cosine` against unit items, `l2` returns the
    squared distance, smallest first. `allowed` (item_id) restricts the items of all queries; `filters` has a row of conditions
    per query (see `items.FILTERS`), met by the columns of `meta`. Both apply before the cut, or with filter_mode="post"
    after a cut at k * oversample, in which case fewer than k may remain.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")).where("vector is not null")
    x = items.select(F.col(item_id).alias("item_id"), F.col(vector).alias("vector")).where("vector is not null")
    ids = None if allowed is None else allowed.select(F.col(item_id).alias("item_id"))
    about = None if meta is None else meta.withColumnRenamed(item_id, "item_id")
    asked = None if filters is None else filters.withColumnRenamed(query_id, "query_id")
    post = filter_mode == "post"
    first, keep = (k * max(1, oversample) if post else k), None
    if not post:
        if ids is not None:
            x = x.join(ids, "item_id", "left_semi")
        if asked is not None:
            q, x, keep = item_tables.with_filters(q, x, asked, about, "query_id", "item_id")
    hits = top_k_scores(q, x, _Vectors(metric), first, query_id="query_id", item_id="item_id", keep=keep, broadcast_rows=broadcast_rows, block_rows=CELL_QUERIES)
    if post:
        if ids is not None:
            hits = hits.join(ids, "item_id", "left_semi")
        if asked is not None:
            hits = item_tables.passing(hits, asked, about, "query_id", "item_id")
        hits = top_k(hits, ["query_id"], [F.desc("score"), F.col("item_id")], k)
    if metric == "l2":
        hits = hits.withColumn("score", F.abs("score"))
    return hits.select("query_id", "item_id", "score")


def mean_vector(items: DataFrame, vector: str = "vector", by: list[str] | None = None) -> DataFrame:
    """Element-wise mean per group (or overall), as a partial aggregate over vectors."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(vx.as_double(F.col(vector)))))
    return items.groupBy(*(by or [])).agg(mean.alias(vector))


def probe(queries: DataFrame, items: DataFrame, *, query_id: str = "query_id", vector: str = "vector",
          sample_share: float | None = None, item_id: str = "item_id") -> DataFrame:
    """Per query: its norm and its cosine to the mean item vector.

    With `sample_share` the mean is taken over that share of items, chosen by hash of the id.
    """
    base = items
    if sample_share is not None:
        base = items.where(hash_uniform(F.col(item_id), seed="probe") < sample_share)
    centred = queries.withColumn("__centre", mean_vector(base, vector).scalar())
    return centred.select(F.col(query_id).alias("query_id"), vx.norm(F.col(vector)).alias("query_norm"),
                          vx.cosine(F.col(vector), F.col("__centre")).alias("cosine_to_mean"))


def check_dimensions(items: DataFrame, vector: str = "vector") -> DataFrame:
    """Row count, smallest and largest vector size, and whether they agree."""
    return items.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("min_dim"),
                     F.max(F.size(vector)).alias("max_dim")).withColumn(
        "consistent", F.col("min_dim") == F.col("max_dim"))


def norm_report(items: DataFrame, metric: str, vector: str = "vector") -> DataFrame:
    """Index statistics: rows, dimension, metric, mean / population std / max of the norms."""
    n = vx.norm(F.col(vector))
    return items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dim"), F.lit(metric).alias("metric"),
                     F.avg(n).alias("norm_mean"), F.stddev_pop(n).alias("norm_std"), F.max(n).alias("norm_max"))


def provenance_mismatch(items: DataFrame, query_model: str, model: str = "embedding_model") -> DataFrame:
    """Models of the index that neither contain the query model's name nor are contained in it."""
    wanted = F.lit(query_model)
    matches = F.col(model).contains(wanted) | wanted.contains(F.col(model))
    return (items.where(F.col(model).isNotNull()).groupBy(model).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col(model).alias("index_model"), wanted.alias("query_model"), "n", matches.alias("matches")))
