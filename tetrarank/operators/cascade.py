"""Dominance gating and cascade routing for a whole batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS
from tetrarank.functions import distributions as dx
from tetrarank.functions import vectors as vx
from tetrarank.operators.scale import checkpoint_dir, top_k
from tetrarank.operators.scoring import zscores

# Experts still active after a dominant expert has chosen the pool.
ACTIVE_AFTER = {
    "alpha": ["alpha", "beta", "gamma"],
    "beta": ["alpha", "beta", "gamma"],
    "gamma": ["alpha", "beta"],
    "delta": ["alpha", "beta", "gamma"],
}
POOL_SIZE = {"alpha": 250, "beta": 250, "gamma": 200, "delta": 200}


def gate(weights: Column, tau: float = 0.75, max_entropy_bits: float = 1.3, margin: float = 0.20) -> Column:
    """struct(gated, dominant, wmax, entropy_bits, gap) for an array of four weights.

    Gated when the largest normalized weight reaches tau, the entropy stays under the ceiling and the
    lead over the second weight reaches the margin. Null, NaN or infinite weights never gate.
    """
    finite = F.forall(weights, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    names = F.array(*[F.lit(e) for e in EXPERTS])

    def decide(normal: Column) -> Column:
        ranked = F.sort_array(normal, asc=False)
        gap, bits = ranked[0] - ranked[1], dx.entropy_bits(normal)
        gated = finite & (ranked[0] >= tau) & (bits <= max_entropy_bits) & (gap >= margin)
        return F.struct(F.coalesce(gated, F.lit(False)).alias("gated"),
                        F.when(finite, names[dx.argmax(normal)]).otherwise(F.lit(EXPERTS[0])).alias("dominant"),
                        F.when(finite, ranked[0]).alias("wmax"), F.when(finite, bits).alias("entropy_bits"),
                        F.when(finite, gap).alias("gap"))

    normalized = vx.let(vx.total(weights) + F.lit(1e-9), lambda t: F.transform(
        vx.as_double(weights), lambda x: F.greatest(x / t, F.lit(1e-9))))
    return vx.let(normalized, decide)


def _restricted(active: dict[str, Column]) -> list[Column]:
    """Weights of the active experts divided by their sum, zero for the others."""
    kept = [F.when(active[e], F.col(f"w_{e}")).otherwise(0.0) for e in EXPERTS]
    total = reduce(lambda a, b: a + b, kept) + F.lit(1e-9)
    return [k / total for k in kept]


def _decide(weights: DataFrame, use_cascade: bool, tau: float, entropy_bits: float, margin: float) -> DataFrame:
    """Weights with the gate's decision: gated, dominant."""
    w_array = F.array(*[F.col(f"w_{e}") for e in EXPERTS])
    decision = gate(w_array, tau, entropy_bits, margin)
    return weights.select("*", (decision["gated"] & F.lit(use_cascade)).alias("gated"),
                          decision["dominant"].alias("dominant"))


def _active() -> dict[str, Column]:
    return {e: F.col("dominant").isin([d for d, kept in ACTIVE_AFTER.items() if e in kept]) for e in EXPERTS}


def route(scored: DataFrame, weights: DataFrame, *, query_id: str = "query_id", item_id: str = "item_id",
          layer2_weights: DataFrame | None = None, use_cascade: bool = True, tau: float = 0.75,
          entropy_bits: float = 1.3, margin: float = 0.20, pool_size: dict[str, int] | None = None,
          zmode: str = "pop") -> DataFrame:
    """Fused scores of every query: query_id, item_id, layer, score_final.

    `scored` has raw score_* columns; `weights` (and optionally `layer2_weights`) one row per query with
    w_* columns. Ungated queries are fused over all candidates. For gated ones the dominant expert's best
    items form the pool, z-scores are recomputed inside it and the remaining experts are fused.

    Scores and pools are read several times, so both are stored in the checkpoint folder first, and so are the
    gate's decisions, which would otherwise be evaluated again for every scored row.
    """
    sizes = pool_size or POOL_SIZE
    z_columns = {f"score_{e}": f"z_{e}" for e in EXPERTS}
    checkpoint_dir(scored.sparkSession)
    raw = scored.select(query_id, item_id, *z_columns).checkpoint()
    decided = _decide(weights, use_cascade, tau, entropy_bits, margin).checkpoint()

    first = zscores(raw.join(decided, query_id), [query_id], z_columns, zmode)
    flat = first.where(~F.col("gated")).select(
        query_id, item_id, F.lit(1).alias("layer"), _fused(_restricted(_everyone())).alias("score_final"))

    own = F.coalesce(*[F.when(F.col("dominant") == e, F.col(f"z_{e}")) for e in EXPERTS])
    other = (F.when(F.col("dominant") == "alpha", F.col("z_beta"))
             .when(F.col("dominant") == "beta", F.col("z_alpha")))
    limit = F.coalesce(*[F.when(F.col("dominant") == e, F.lit(sizes[e])) for e in EXPERTS])
    keys = F.explode(F.array(F.struct(F.lit("own").alias("list"), own.alias("z")),
                             F.struct(F.lit("other").alias("list"), other.alias("z"))))
    listed = (first.where("gated").select(query_id, item_id, limit.alias("limit"), keys.alias("k"))
              .select(query_id, item_id, "limit", "k.list", F.round("k.z", 6).alias("z")).where("z is not null"))
    pool = (top_k(listed, [query_id, "list"], [F.desc("z"), F.col(item_id)], max(sizes.values()), rank="r")
            .where(F.col("r") <= F.col("limit")).select(query_id, item_id).distinct().checkpoint())

    second = zscores(raw.join(pool, [query_id, item_id]), [query_id], z_columns, zmode)
    later = (layer2_weights if layer2_weights is not None else weights).join(decided.select(query_id, "dominant"), query_id)
    refined = second.join(later, query_id).select(
        query_id, item_id, F.lit(2).alias("layer"), _fused(_restricted(_active())).alias("score_final"))
    return flat.unionByName(refined)


def route_log(weights: DataFrame, *, query_id: str = "query_id", layer2_weights: DataFrame | None = None,
              use_cascade: bool = True, tau: float = 0.75, entropy_bits: float = 1.3, margin: float = 0.20) -> DataFrame:
    """Layer log: one row per query and layer with the gate's decision and the weights in force."""
    decided = _decide(weights, use_cascade, tau, entropy_bits, margin)
    first = decided.select(query_id, F.lit(1).alias("layer"), "gated", F.when(F.col("gated"), F.col("dominant")).alias("expert"),
                           *[w.alias(f"w_{e}") for w, e in zip(_restricted(_everyone()), EXPERTS)])
    gated = decided.where("gated").select(query_id, "dominant")
    later = (layer2_weights if layer2_weights is not None else weights).join(gated, query_id)
    second = later.select(query_id, F.lit(2).alias("layer"), F.lit(True).alias("gated"), F.col("dominant").alias("expert"),
                          *[w.alias(f"w_{e}") for w, e in zip(_restricted(_active()), EXPERTS)])
    return first.unionByName(second)


def _everyone() -> dict[str, Column]:
    return {e: F.lit(True) for e in EXPERTS}


def _fused(weights: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [w * F.col(f"z_{e}") for w, e in zip(weights, EXPERTS)])
