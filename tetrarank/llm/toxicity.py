"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, other text is unlabelled: some of it is toxic, too, in the share of the class
prior. A linear classifier g over words and word beginnings minimises the corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),    l(z) = log(1 + exp(-z)),

whose second part, the risk on the unseen negatives, can't be driven below zero by overfitting: where it is, the step
climbs back (Kiryo et al., 2017). It is fitted with numpy on a bounded sample of the texts; every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import drop_stored, per_batch, stored, texts

#: ASCII other than letters parts words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
BEGINNINGS = (4, 5, 6, 7, 8)


def distinct_words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def features_of(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(word + b"$"), *[zlib.crc32(word[:n]) for n in BEGINNINGS if len(word) > n]]


class Model:
    """weights: by feature hash; a text's g is the bias plus the weights of its distinct words."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def _word(self, word: bytes) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > 300_000:  # bounds memory only
                self.known.clear()
            value = self.known[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return value

    def score(self, text: str) -> float:
        g = self.bias + sum(sorted(map(self._word, distinct_words(text))))
        return float(1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, g)))))


def _rows(samples: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of the chosen features."""
    sizes = [len(s) for s in samples]
    flat = np.concatenate(samples) if samples else np.empty(0, np.uint32)
    row = np.repeat(np.arange(len(samples)), sizes)
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    own = chosen[at] == flat
    return row[own], at[own]


def chosen_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int = 4000, least: int = 3) -> np.ndarray:
    """Of the features that `least` positive texts or more have, or ten times as many unlabelled ones, those whose presence differs
    most between both samples: `features`, and no more than ten for each positive text."""
    def present(samples):
        return np.unique(np.concatenate([np.unique(s) for s in samples]), return_counts=True)

    (in_p, n_p), (in_u, n_u) = present(positive), present(unlabelled)
    names = np.union1d(in_p, in_u)
    p, u = np.zeros(len(names)), np.zeros(len(names))
    p[np.searchsorted(names, in_p)], u[np.searchsorted(names, in_u)] = n_p, n_u
    share_p, share_u, both = p / len(positive), u / len(unlabelled), (p + u) / (len(positive) + len(unlabelled))
    lift = np.abs(share_p - share_u) / np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-6)
    known = np.flatnonzero((p >= least) | (u >= 10 * least))
    order = known[np.lexsort((names[known], -lift[known]))]
    return np.sort(names[order[:min(features, 10 * len(positive))]])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, chosen: np.ndarray | None = None, steps: int = 300,
        rate: float = 0.05, decay: float = 5e-4) -> Model:
    """The classifier from the feature hashes of positive and unlabelled texts, over the chosen features."""
    if not positive or not unlabelled:
        return Model({}, -50.0)
    if chosen is None:
        chosen = chosen_features(positive, unlabelled)
    if not len(chosen):
        return Model({}, float(np.log(prior / (1 - prior))))
    (rp, fp), (ru, fu) = _rows(positive, chosen), _rows(unlabelled, chosen)
    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)

    def margins(row, feature, n):
        return bias + np.bincount(row, weights=w[feature], minlength=n)

    def sigmoid(z):
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))

    for step in range(1, steps + 1):
        gp, gu = margins(rp, fp, len(positive)), margins(ru, fu, len(unlabelled))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        on_p = -prior * sigmoid(-gp) / len(positive)  # derivative of the positive part by each margin
        neg_p, neg_u = -prior * sigmoid(gp) / len(positive), sigmoid(gu) / len(unlabelled)
        if negative >= 0:
            dp, du = on_p + neg_p, neg_u
        else:
            dp, du = -neg_p, -neg_u
        grad = np.append(np.bincount(fp, weights=dp[rp], minlength=len(chosen)) + np.bincount(fu, weights=du[ru], minlength=len(chosen)) + decay * w,
                         dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(dict(zip(chosen.tolist(), w.tolist(), strict=True)), float(bias))


def remainder(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def first_by_hash(rows: DataFrame, most: int, *groups: str) -> DataFrame:
    """The distinct (t_id, groups) of `rows` among which are, of each group, the `most` ids with the smallest hashes.

    A bound on the hash, from an approximate count of the ids of each group, cuts the rows where they are read, so some
    4 * most + 200 ids a group are moved, whatever the number of rows; a smaller group keeps all its ids.
    """
    wanted, n_ids = 4.0 * most + 200, F.approx_count_distinct("t_id").alias("n_ids")
    if groups:
        counted = rows.groupBy(*groups).agg(n_ids).select(*[F.col(g).alias(f"g_{g}") for g in groups], (F.lit(wanted) / F.greatest("n_ids", F.lit(1))).alias("share"))
        rows = rows.join(F.broadcast(counted), reduce(and_, [F.col(g) == F.col(f"g_{g}") for g in groups]))  # one row per group
        share = F.col("share")
    else:
        share = F.lit(wanted / max(1, rows.agg(n_ids).first()[0]))
    return rows.where(F.xxhash64("t_id") / F.lit(2.0 ** 64) + 0.5 < share).select("t_id", *groups).distinct()


def sampled(rows: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """doc_id, text: one text of each of at most `most` of the ids in `rows` (t_id), chosen by hash.

    An id that is repeated gives the text with the smallest hash, so the result has at most `most` rows. Only ids, at most
    that many, reach the driver.
    """
    ids = [r[0] for r in first_by_hash(rows, most).orderBy(F.xxhash64("t_id"), "t_id").limit(most).collect()]
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "t_id bigint")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(wanted), F.col("doc_id") == F.col("t_id"))
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


COUNTED = pa.schema([("feature", pa.int64()), ("toxic", pa.int32()), ("n", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("features", pa.binary())])


def _hashes(text: str) -> np.ndarray:
    return np.array([f for w in sorted(distinct_words(text)) for f in features_of(w)], np.uint32)


def _counted(sample: DataFrame) -> DataFrame:
    """feature, texts of each kind that have it, added up within each batch first."""
    def work(batch):
        kinds, rows = batch.column(1).to_numpy(zero_copy_only=False), texts(batch.column(2))
        out: dict[str, list] = {"feature": [], "toxic": [], "n": []}
        for kind in (0, 1):
            own = [np.unique(_hashes(t)) for t, k in zip(rows, kinds, strict=True) if k == kind]
            found, n = np.unique(np.concatenate(own), return_counts=True) if own else ([], [])
            out["feature"] += list(found)
            out["toxic"] += [kind] * len(found)
            out["n"] += list(n)
        return out

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(per_batch(COUNTED, work), "feature bigint, toxic int, n bigint")
    return rows.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"),
                                       F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("u"))


def _kept(sample: DataFrame, chosen: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text of each kind, its chosen features; only these leave the tasks."""
    def work(batch):
        found = [_hashes(t) for t in texts(batch.column(2))]
        return {"doc_id": batch.column(0), "toxic": batch.column(1), "features": [f[np.isin(f, chosen)].tobytes() for f in found]}

    got = sample.select("doc_id", "toxic", "text").mapInArrow(per_batch(KEPT, work), "doc_id bigint, toxic int, features binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.features)))
    return tuple([np.frombuffer(r.features, np.uint32) for r in got if r.toxic == kind] for kind in (1, 0))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, out: int = 0, positives: int = 3000, unlabelled: int = 9000,
          features: int = 4000, least: int = 3) -> Model:
    """Fit on texts whose crc32(doc_id) modulo `modulus` is not `out`: at most `positives` toxic and `unlabelled` other ones.

    The prior is the share of toxic rows among the labelled ones that may be learned from. Features are counted and chosen by
    Spark; the driver gets the chosen ones of each text of the sample. A text can be in both samples.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("t_id"), F.col("toxic").cast("int").alias("toxic")).where(
        (remainder("t_id", modulus) != out) & F.col("toxic").isNotNull())
    prior, count = rows.agg(F.avg("toxic"), F.sum("toxic")).first()
    if not count:
        return Model({}, -50.0)
    ids = docs.select(F.col("doc_id").cast("long").alias("t_id")).where((remainder("t_id", modulus) != out))
    sample = stored(sampled(rows.where("toxic = 1"), docs, positives).select("doc_id", F.lit(1).alias("toxic"), "text").unionByName(
        sampled(ids, docs, unlabelled).select("doc_id", F.lit(0).alias("toxic"), "text")), "toxicity-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model({}, -50.0)
    both = (F.col("p") + F.col("u")) / F.lit(float(n[0] + n[1]))
    spread = F.sqrt(both * (1 - both) * F.lit(1 / n[1] + 1 / n[0]) + 1e-6)
    lift = F.abs(F.col("p") / F.lit(float(n[1])) - F.col("u") / F.lit(float(n[0]))) / spread
    best = _counted(sample).where((F.col("p") >= least) | (F.col("u") >= 10 * least)).orderBy(lift.desc(), "feature").limit(min(features, 10 * n[1])).select("feature")
    chosen = np.array(sorted(r.feature for r in best.collect()), np.uint32)
    toxic, other = _kept(sample, chosen)
    drop_stored(docs.sparkSession, sample)
    return fit(toxic, other, min(0.95, float(prior)), chosen)


def scores(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for each whole text; null counts as empty."""
    return docs.withColumn(out, _scorer(model.weights, model.bias)(F.col("text").cast("string")))


def _scorer(weights: dict, bias: float):
    """A pandas function that keeps one model for all batches of a task."""

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias)
        for column in parts:
            yield column.fillna("").map(own.score).astype("float64")

    return F.pandas_udf(of, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learned without labels of the documents whose crc32(doc_id as text) modulo 5 is 0; those are held out. Only the text
    makes a score. Null and empty texts get the score of a text without words; without a toxic example all scores are
    next to 0. A null doc_id counts as held out. Repeated rows get the same score. An empty table gives an empty result.
    """
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scores(rows, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return scores(docs, learn(docs, labels), "__toxicity").where(F.col("__toxicity") < threshold).select(*kept)
