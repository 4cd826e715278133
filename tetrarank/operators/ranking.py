"""Ranking metrics and listwise losses for (method, prompt, item) score rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS
from tetrarank.functions import numeric as nx
from tetrarank.operators.blocks import block_pairs
from tetrarank.operators.lists import best_first, per_list
from tetrarank.operators.scale import by_size, ranked_totals, top_k, with_list_stats

DECIMALS = 9
#: Lists of at most so many rows are computed where they lie after one shuffle, many at a time.
LIST_ROWS = 2_000


def unpivot_methods(df: DataFrame, methods: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per method and list entry: method, kept columns, score."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.cast("double").alias("score"))
                                  for m, c in methods.items()]))
    return df.select(*keep, entries.alias("__m")).select("__m.method", *keep, "__m.score")


def mixture_methods(z: str = "z_", weights: str | None = None, prompt: str = "prompt_id", item: str = "item_id",
                    random_trials: int = 0, seed: str = "42") -> dict[str, Column]:
    """Experts alone, their uniform mixture, the mixture by per-prompt weight columns, and random trials."""
    signals = [F.col(f"{z}{e}") for e in EXPERTS]
    methods = {e: s for e, s in zip(EXPERTS, signals)}
    methods["uniform"] = sum(signals[1:], signals[0]) / 4.0
    if weights:
        methods["oracle"] = nx.weighted_margin([F.col(f"{weights}{e}") for e in EXPERTS], signals)
    for t in range(random_trials):
        methods[f"random_{t}"] = nx.hash_uniform(F.lit(t), F.col(prompt), F.col(item), seed=seed)
    return methods


def _discounted(gain: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), gain) - 1.0) / F.log2(rank + 1.0)


def list_metrics(rows: DataFrame, k: int = 10, threshold: float = 0.9, by: list[str] | None = None,
                 relevance: str = "gt_score", item: str = "item_id") -> DataFrame:
    """nDCG@k (gain 2^rel - 1), reciprocal rank of the first relevant item, share of relevant items in the top k.

    Lists are bounded by retrieval: both orders and the sums need the one shuffle that brings a list together.
    """
    by = by or ["method", "prompt_id"]
    lists = W.partitionBy(*by)
    ranked = rows.select(*by, item, relevance, F.round("score", DECIMALS).alias("__s")).select(
        *by, relevance, F.row_number().over(lists.orderBy(F.desc("__s"), item)).alias("__p"),
        F.row_number().over(lists.orderBy(F.desc(relevance), item)).alias("__g"))
    relevant = F.col(relevance) >= threshold

    def gained(rank: str) -> Column:
        return F.sum(F.when(F.col(rank) <= k, _discounted(F.col(relevance), F.col(rank))))

    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), gained("__p").alias("__dcg"), gained("__g").alias("__idcg"),
        F.min(F.when(relevant, F.col("__p"))).alias("__first"), F.sum(relevant.cast("long")).alias("__total"),
        F.sum((relevant & (F.col("__p") <= k)).cast("long")).alias("__hits"))
    return sums.select(
        *by, "n_items",
        F.when(F.col("__idcg") == 0, 0.0).otherwise(F.col("__dcg") / F.col("__idcg")).alias("ndcg"),
        F.when(F.col("__first").isNull(), 0.0).otherwise(1.0 / F.col("__first")).alias("mrr"),
        F.when(F.col("__total") == 0, 0.0).otherwise(F.col("__hits") / F.col("__total")).alias("hit"))


def method_report(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population std of the list metrics per method (and further columns)."""
    aggregates = [F.count(F.lit(1)).alias("n_prompts")]
    for m in ("ndcg", "mrr", "hit"):
        aggregates += [F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(*(by or ["method"])).agg(*aggregates)


def random_baseline(metrics: DataFrame) -> DataFrame:
    """Mean over trials of the trial means, with their population std."""
    trials = metrics.where(F.col("method").startswith("random_")).groupBy("method").agg(
        *[F.avg(m).alias(m) for m in ("ndcg", "mrr", "hit")], F.count(F.lit(1)).alias("n"))
    return trials.agg(F.lit("random").alias("method"), F.sum("n").alias("n_prompts"),
                      *[c for m in ("ndcg", "mrr", "hit") for c in (F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std"))])


def listmle(rows: DataFrame, by: list[str], score: str = "score", relevance: str = "gt_score",
            item: str = "item_id", eps: float = 1e-10) -> DataFrame:
    """Negative log-likelihood of the ground-truth order: minus the sum of s_i - log of the tail sums."""
    def losses(_, s: np.ndarray, there: np.ndarray, *__) -> tuple[np.ndarray, ...]:
        d = s - np.where(there, s, -np.inf).max(axis=1, keepdims=True)
        tails = np.cumsum(np.where(there, np.exp(d), 0.0)[:, ::-1], axis=1)[:, ::-1]
        return (np.where(there.any(axis=1), -np.where(there, d - np.log(tails + eps), 0.0).sum(axis=1), np.nan),)

    def short_lists(short: DataFrame) -> DataFrame:
        return per_list(short, by, best_first(relevance, item), item, score, relevance, losses, {"listmle": "double"}, 2)

    def long_lists(large: DataFrame) -> DataFrame:
        shifted = with_list_stats(large, by, {"__top": F.max(score)}).withColumn(
            "__d", F.col(score) - F.col("__top"))
        tails = ranked_totals(shifted, by, relevance, [item], {"__tail": F.exp("__d")}, reverse=True)
        return tails.groupBy(*by).agg((-F.sum(F.col("__d") - F.ln(F.col("__tail") + eps))).alias("listmle"))

    return _by_length(rows, by, LIST_ROWS, short_lists, long_lists)


def _by_length(rows: DataFrame, by: list[str], most: int, short_lists: Callable, long_lists: Callable) -> DataFrame:
    """Results of lists of at most `most` rows and of longer ones, which are dealt out."""
    if not by:
        return long_lists(rows)
    short, large = by_size(rows, by, most)
    return short_lists(short) if large is None else short_lists(short).unionByName(long_lists(large))


def listnet(rows: DataFrame, by: list[str], score: str = "score", relevance: str = "gt_score",
            temperature: float = 1.0) -> DataFrame:
    """Cross-entropy between the top-one distributions of ground truth and prediction."""
    t = F.lit(float(temperature))
    tops = with_list_stats(rows, by, {"__ms": F.max(score), "__mg": F.max(relevance)})
    exps = tops.withColumns({"__es": F.exp((F.col(score) - F.col("__ms")) / t),
                             "__eg": F.exp((F.col(relevance) - F.col("__mg")) / t)})
    sums = with_list_stats(exps, by, {"__zs": F.sum("__es"), "__zg": F.sum("__eg")})
    term = F.col("__eg") / F.col("__zg") * F.ln(F.col("__es") / F.col("__zs") + 1e-10)
    return sums.groupBy(*by).agg((-F.sum(term)).alias("listnet"))


def ranknet(rows: DataFrame, by: list[str], score: str = "score", relevance: str = "gt_score",
            item: str = "item_id", block_rows: int = 2_000) -> DataFrame:
    """Mean softplus(-(s_i - s_j)) over pairs with rel_i > rel_j, summed block against block.

    Every unordered pair is visited in both directions and counts twice in sum and count alike.
    """
    def losses(_, s: np.ndarray, __, g: np.ndarray, ___) -> tuple[np.ndarray, ...]:
        sign = np.sign(g[:, :, None] - g[:, None, :])
        margin = sign * (s[:, :, None] - s[:, None, :])
        loss = np.maximum(-margin, 0.0) + np.log1p(np.exp(-np.abs(margin)))
        apart = sign != 0
        n = apart.sum(axis=(1, 2))
        return np.where(apart, loss, 0.0).sum(axis=(1, 2)) / (n + 1e-10), n // 2

    def short_lists(short: DataFrame) -> DataFrame:
        out = {"ranknet": "double", "pairs": "long"}
        return per_list(short.dropna(subset=by), by, best_first(relevance, item), item, score, relevance, losses, out, 3)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sign = np.sign(left[relevance].to_numpy()[:, None] - right[relevance].to_numpy()[None, :])
        margin = sign * (left[score].to_numpy()[:, None] - right[score].to_numpy()[None, :])
        loss = np.where(sign != 0, np.logaddexp(0.0, -margin), 0.0)
        head = left[by].head(1).reset_index(drop=True)
        return head.assign(loss=float(loss.sum()), pairs=int((sign != 0).sum()))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", loss double, pairs long"

    def long_lists(large: DataFrame) -> DataFrame:
        parts = block_pairs(large, by, item, cell, schema, block_rows=block_rows, carry=[score, relevance])
        return parts.groupBy(*by).agg((F.sum("loss") / (F.sum("pairs") + 1e-10)).alias("ranknet"),
                                      (F.sum("pairs") / 2).cast("long").alias("pairs"))

    return _by_length(rows, by, block_rows, short_lists, long_lists)


def approx_ndcg(rows: DataFrame, by: list[str], score: str = "score", relevance: str = "gt_score",
                item: str = "item_id", temperature: float = 1.0, k: int | None = None,
                block_rows: int = 2_000) -> DataFrame:
    """1 - soft nDCG with linear gains; soft positions are sums of sigmoids over the list, block by block.

    An item's soft rank adds up sigmoid((s_i - s_j) / T) over the whole list including itself, its soft
    position is n + 1 minus that, and with k only the k items of smallest soft rank are credited.
    """
    def losses(items: np.ndarray, s: np.ndarray, _, g: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        soft = (1.0 / (1.0 + np.exp((s[:, None, :] - s[:, :, None]) / temperature))).sum(axis=2)
        n = s.shape[1]
        gains = g / np.log2(n + 2.0 - soft)
        ordered = np.sort(items, axis=1)
        for row in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1)):  # rows of one item are put together
            own, at = np.unique(items[row], return_inverse=True)
            ranks, best = np.zeros(len(own)), np.full(len(own), np.nan)
            np.add.at(ranks, at, soft[row])
            np.fmax.at(best, at, g[row])
            gains[row] = np.nan
            gains[row, :len(own)] = best / np.log2(len(own) + 2.0 - ranks)
        dcg = np.where(np.isnan(gains).all(axis=1), np.nan, np.nansum(gains, axis=1))
        ideal = np.where(known, g / np.log2(np.arange(2.0, n + 2.0)), 0.0).sum(axis=1)
        return (np.where(known.any(axis=1), 1.0 - dcg / (ideal + 1e-10), np.nan),)

    def short_lists(short: DataFrame) -> DataFrame:
        return per_list(short.dropna(subset=by), by, best_first(relevance, item), item, score, relevance, losses, {"approx_ndcg": "double"}, 3)

    def long_lists(large: DataFrame) -> DataFrame:
        return _dealt_ndcg(large, by, score, relevance, item, temperature, k, block_rows)

    return long_lists(rows) if k is not None else _by_length(rows, by, block_rows, short_lists, long_lists)


def _dealt_ndcg(rows: DataFrame, by: list[str], score: str, relevance: str, item: str, temperature: float, k: int | None, block_rows: int) -> DataFrame:
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        diff = (left[score].to_numpy()[:, None] - right[score].to_numpy()[None, :]) / temperature
        soft = np.exp(-np.logaddexp(0.0, -diff)).sum(axis=1)
        return left[[*by, item, relevance]].assign(soft=soft)

    types = {c: rows.schema[c].dataType.simpleString() for c in [*by, item]}
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + f", {relevance} double, soft double"
    parts = block_pairs(rows.withColumn(relevance, F.col(relevance).cast("double")), by, item, cell, schema,
                        block_rows=block_rows, carry=[score, relevance])
    ranks = parts.groupBy(*by, item).agg(F.max(relevance).alias(relevance), F.sum("soft").alias("__soft"))
    sized = with_list_stats(ranks, by, {"__n": F.count(F.lit(1))})
    discount = 1.0 / F.log2(F.col("__n") + 2.0 - F.col("__soft"))
    credited = sized.withColumn("__gain", F.col(relevance) * discount)
    if k is not None:
        credited = top_k(credited, by, [F.round("__soft", 9), F.col(item)], k)
    predicted = credited.groupBy(*by).agg(F.sum("__gain").alias("__dcg"))
    ranked = (top_k(rows, by, [F.desc(relevance), F.col(item)], k, rank="__r") if k is not None else
              ranked_totals(rows, by, relevance, [item], {"__r": F.lit(1)}))
    ideal = ranked.groupBy(*by).agg(F.sum(F.col(relevance) / F.log2(F.col("__r") + 1.0)).alias("__idcg"))
    return predicted.join(ideal, by).select(
        *by, (1.0 - F.col("__dcg") / (F.col("__idcg") + 1e-10)).alias("approx_ndcg"))


def grouped_softmax(rows: DataFrame, by: list[str], columns: dict[str, str], temperature: float = 1.0) -> DataFrame:
    """Softmax over the rows of each group, for several columns in two aggregations."""
    t = F.lit(float(temperature))
    tops = with_list_stats(rows, by, {f"__m{i}": F.max(c) for i, c in enumerate(columns)})
    exps = tops.withColumns({f"__e{i}": F.exp((F.col(c) - F.col(f"__m{i}")) / t) for i, c in enumerate(columns)})
    sums = with_list_stats(exps, by, {f"__z{i}": F.sum(f"__e{i}") for i in range(len(columns))})
    out = sums.withColumns({o: F.col(f"__e{i}") / F.col(f"__z{i}") for i, o in enumerate(columns.values())})
    return out.drop(*[f"__{p}{i}" for i in range(len(columns)) for p in "mez"])
