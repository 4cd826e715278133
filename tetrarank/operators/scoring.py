"""From expert hits to fused rankings: pooling, outer union, z-scores, weights, fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS
from tetrarank.functions import numeric as nx
from tetrarank.operators.scale import top_k, with_list_stats


def pool(hits: DataFrame, by: list[str], score: str = "score", how: str = "sum", *, temperature: float = 1.0,
         tau_min: float = 1e-3, clip: float = 50.0) -> DataFrame:
    """Chunk scores to item scores: sum, max, or softmax-weighted mean (`attn`)."""
    if how in ("sum", "max"):
        return hits.groupBy(*by).agg((F.sum if how == "sum" else F.max)(score).alias(score))
    if how != "attn":
        raise ValueError(f"unknown pooling {how!r}")
    tau = max(tau_min, float(temperature))
    shifted = with_list_stats(hits, by, {"__top": F.max(score)})
    weight = F.exp(F.greatest((F.col(score) - F.col("__top")) / F.lit(tau), F.lit(-clip)))
    return (shifted.withColumn("__w", weight).groupBy(*by)
            .agg((F.sum(F.col("__w") * F.col(score)) / F.sum("__w")).alias(score)))


def zscores(df: DataFrame, by: list[str], columns: dict[str, str], mode: str = "pop") -> DataFrame:
    """Per-group standardization; `columns` maps input to output names.

    `pop`: population std, eps 1e-8, std 0 gives 0. `pop_strict`: population std, below 1e-8 gives 0.
    `clip_sample`: sample std, clipped to +-3, single rows and std <= 1e-12 give 0.
    """
    spread = F.stddev_samp if mode == "clip_sample" else F.stddev_pop
    stats = {}
    for i, c in enumerate(columns):
        stats |= {f"__mu{i}": F.avg(c), f"__sd{i}": spread(c)}
    joined = with_list_stats(df, by, stats)
    for i, (c, out) in enumerate(columns.items()):
        centred, sd = F.col(c) - F.col(f"__mu{i}"), F.col(f"__sd{i}")
        if mode == "pop":
            z = F.when(sd == 0, 0.0).otherwise(centred / (sd + 1e-8))
        elif mode == "pop_strict":
            z = F.when(sd < 1e-8, 0.0).otherwise(centred / F.greatest(sd, F.lit(1e-8)))
        elif mode == "clip_sample":
            z = F.when(sd.isNull() | (sd <= 1e-12), 0.0).otherwise(nx.clip(centred / (sd + 1e-12), -3.0, 3.0))
        else:
            raise ValueError(f"unknown mode {mode!r}")
        joined = joined.withColumn(out, z)
    return joined.drop(*[s for i in range(len(columns)) for s in (f"__mu{i}", f"__sd{i}")])


def outer_union(frames: dict[str, DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """Full outer join of score frames on the keys, missing scores 0, in a single shuffle."""
    tagged = [df.select(*keys, F.lit(name).alias("__source"), F.col(score).cast("double").alias("__score"))
              for name, df in frames.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    return stacked.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("__source") == name, F.col("__score"))), F.lit(0.0)).alias(name)
        for name in frames])


def normalize_weights(weights: dict[str, float], fallback: dict[str, float] | None = None) -> dict[str, float]:
    """Negatives to zero, then divide by the sum; a zero sum divides by one or returns the fallback."""
    raised = {k: max(0.0, float(v or 0.0)) for k, v in weights.items()}
    total = sum(raised.values())
    if total <= 0.0:
        return dict(fallback) if fallback else raised
    return {k: v / total for k, v in raised.items()}


def weight_columns(weights: list[str], bm25_only: bool = False) -> list[Column]:
    """The same rule for weights held in columns; a zero sum gives zeros, or all weight to the second."""
    raised = [F.greatest(F.col(w), F.lit(0.0)) for w in weights]
    total = reduce(lambda a, b: a + b, raised)
    return [F.when(total > 0, r / total).otherwise(F.lit(1.0 if bm25_only and i == 1 else 0.0)).alias(w)
            for i, (w, r) in enumerate(zip(weights, raised))]


def fuse(df: DataFrame, weights: dict[str, float] | DataFrame, *, query_id: str = "query_id", z: str = "z_",
         w: str = "w_", contributions: bool = True, score: str = "score_final") -> DataFrame:
    """Weighted sum of z columns. Weights are a dict for all queries or a frame of one row per query."""
    if isinstance(weights, dict):
        joined = df.select("*", *[F.lit(float(weights.get(e, 0.0))).alias(f"{w}{e}") for e in EXPERTS])
    else:
        joined = df.join(weights, query_id)
    parts = [(F.col(f"{w}{e}") * F.col(f"{z}{e}")) for e in EXPERTS]
    out = joined
    if contributions:
        out = out.select("*", *[p.alias(f"contrib_{e}") for p, e in zip(parts, EXPERTS)])
    return out.withColumn(score, reduce(lambda a, b: a + b, parts))


def dz_summary(df: DataFrame, by: str = "query_id", z: str = "z_", median: str = "lower",
               prefix: str = "dz_") -> DataFrame:
    """Per query and expert: best z minus median z over its candidate list (lower or averaged median).

    Candidate lists are the bounded output of top-k retrieval, so the per-query percentile buffer is too.
    """
    def middle(c: str) -> Column:
        if median == "lower":
            return F.expr(f"percentile_disc(0.5) within group (order by `{c}`)")
        return F.percentile(c, F.lit(0.5))

    return df.groupBy(by).agg(*[(F.max(f"{z}{e}") - middle(f"{z}{e}")).alias(f"{prefix}{e}") for e in EXPERTS])


def final_top(df: DataFrame, m: int, *, query_id: str = "query_id", item_id: str = "item_id",
              score: str = "score_final", decimals: int = 6, meta: DataFrame | None = None) -> DataFrame:
    """Best m items per query with rank, ties by item id; metadata joined to the cut, not to all rows."""
    rounded = df.withColumn(score, F.round(score, decimals))
    out = top_k(rounded, [query_id], [F.desc(score), F.col(item_id)], m, rank="rank")
    return out.join(meta, item_id, "left") if meta is not None else out
