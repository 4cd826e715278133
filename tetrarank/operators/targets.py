"""Target expert weights per prompt: given mixtures, or a small logistic fit per prompt."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS, EXPERTS, MIX_COLUMNS
from tetrarank.functions import numeric as nx
from tetrarank.operators.evaluation import auc
from tetrarank.operators.scale import by_size, checkpoint_dir

WEIGHTS = [f"w_{e}" for e in EXPERTS]


def mixture_targets(pairs: DataFrame, mix: list[str] | None = None, key: str = "pair_id") -> DataFrame:
    """First non-null mixture of each prompt, negatives dropped, divided by the sum; null when the sum is 0."""
    mix = mix or MIX_COLUMNS
    first = [F.greatest(F.coalesce(F.min_by(F.col(f"`{m}`"), F.when(F.col(f"`{m}`").isNotNull(), F.col(key))),
                                   F.lit(0.0)), F.lit(0.0)).alias(w) for m, w in zip(mix, WEIGHTS)]
    rows = pairs.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("pairs_used"), *first)
    total = reduce(lambda a, b: a + b, [F.col(w) for w in WEIGHTS])
    return rows.select("prompt_id", "pairs_used", *[F.when(total > 0, F.col(w) / total).alias(w) for w in WEIGHTS])


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """Newton steps for a batch of prompts from their gradient and Hessian sums."""
    n = len(EXPERTS)
    gradient = rows[[f"g{i}" for i in range(n)]].to_numpy()
    hessian = np.zeros((len(rows), n, n))
    for i in range(n):
        for j in range(i, n):
            hessian[:, i, j] = hessian[:, j, i] = rows[f"h{i}{j}"].to_numpy()
    step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
    return pd.DataFrame(step, columns=[f"s{i}" for i in range(n)])


def stored_pairs(pairs: DataFrame) -> DataFrame:
    """prompt_id, y and the differences, stored once for all fits over the same pairs."""
    checkpoint_dir(pairs.sparkSession)
    return pairs.select("prompt_id", "y", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(DZ_COLUMNS)]).checkpoint()


def _logits_by_passes(base: DataFrame, strength: float, tolerance: float, most_steps: int) -> DataFrame:
    """The fits of prompts of any number of pairs.

    Every Newton step is one pass of partial sums over the pairs, so the pairs of one prompt never have to
    meet in one task; only the small per-prompt systems are solved in Arrow batches. The coefficient table is checkpointed
    after each step, which keeps the plan flat.
    """
    n = len(EXPERTS)
    sums = base.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    usable = sums.where((F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    coefficients = usable.select("prompt_id", "n", "pos", *[F.lit(0.0).alias(f"c{i}") for i in range(n)], F.lit(1.0).alias("moved")).checkpoint()

    @F.pandas_udf(", ".join(f"s{i} double" for i in range(n)))
    def newton(rows: pd.DataFrame) -> pd.DataFrame:
        return _solve(rows)

    for _ in range(most_steps):
        joined = base.join(coefficients, "prompt_id")
        margin = reduce(lambda a, b: a + b, [F.col(f"x{i}") * F.col(f"c{i}") for i in range(n)])
        weight = F.when(F.col("y") == 1, F.col("n") / (2.0 * F.col("pos"))).otherwise(
            F.col("n") / (2.0 * (F.col("n") - F.col("pos"))))
        parts = joined.select("prompt_id", *[f"x{i}" for i in range(n)], (weight * F.lit(strength)).alias("w"),
                              nx.sigmoid(margin).alias("p"), F.col("y").cast("double").alias("y"))
        curvature = F.col("w") * F.col("p") * (1.0 - F.col("p"))
        aggregates = [F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(n)]
        aggregates += [F.sum(curvature * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}{j}")
                       for i in range(n) for j in range(i, n)]
        system = parts.groupBy("prompt_id").agg(*aggregates).join(coefficients, "prompt_id")
        inputs = F.struct(*[(F.col(f"g{i}") + F.col(f"c{i}")).alias(f"g{i}") for i in range(n)],
                          *[(F.col(f"h{i}{j}") + F.lit(1.0 if i == j else 0.0)).alias(f"h{i}{j}")
                            for i in range(n) for j in range(i, n)])
        coefficients = (system.withColumn("step", newton(inputs))
                        .select("prompt_id", "n", "pos", *[(F.col(f"c{i}") - F.col(f"step.s{i}")).alias(f"c{i}") for i in range(n)],
                                F.greatest(*[F.abs(f"step.s{i}") for i in range(n)]).alias("moved"))
                        .checkpoint())
        if (coefficients.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return coefficients.withColumn("converged", F.col("moved") <= tolerance).drop("moved")


def _fit_prompts(rows: pd.DataFrame, strength: float, tolerance: float, most_steps: int) -> pd.DataFrame:
    """Newton steps for whole prompts whose rows lie together; prompts with one label only are left out."""
    k = len(EXPERTS)
    names = ["prompt_id", "n", "pos", *[f"c{i}" for i in range(k)], "converged"]
    key = rows["text"].to_numpy()
    number = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    y, judged = rows["y"].to_numpy(float), rows["judged"].to_numpy(bool)
    count = np.bincount(number)
    positive = np.bincount(number, np.where(judged, y, 0.0))
    usable = (positive > 0) & (positive < count)
    if not usable.any():
        return pd.DataFrame([], columns=names)
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))[usable]
    kept = usable[number]
    number = (np.cumsum(usable) - 1)[number[kept]]
    n, pos, m = count[usable].astype(float), positive[usable], int(usable.sum())
    x, y, judged, whole = rows[[f"x{i}" for i in range(k)]].to_numpy(float)[kept], y[kept], judged[kept], rows["whole"].to_numpy(bool)[kept]
    weight = strength * np.where(judged & (y == 1), n[number] / (2.0 * pos[number]), n[number] / (2.0 * (n - pos)[number]))
    c, moved = np.zeros((m, k)), np.ones(m)
    with np.errstate(over="ignore"):  # exp of a large margin is infinite, its share 0
        for _ in range(most_steps):
            p = 1.0 / (1.0 + np.exp(-(x * c[number]).sum(axis=1)))
            pull = np.where(whole & judged, weight * (p - y), 0.0)
            bend = np.where(whole, weight * p * (1.0 - p), 0.0)
            gradient = np.column_stack([np.bincount(number, pull * x[:, i], m) for i in range(k)]) + c
            hessian = np.zeros((m, k, k))
            for i in range(k):
                for j in range(i, k):
                    hessian[:, i, j] = hessian[:, j, i] = np.bincount(number, bend * x[:, i] * x[:, j], m) + (i == j)
            step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
            c, moved = c - step, np.abs(step).max(axis=1)
            if (moved <= tolerance).all():
                break
    out = pd.DataFrame(c, columns=[f"c{i}" for i in range(k)])
    out.insert(0, "prompt_id", rows["prompt_id"].to_numpy()[first])
    return out.assign(n=n.astype(np.int64), pos=pos.astype(np.int64), converged=moved <= tolerance)[names]


def _logits_in_tasks(base: DataFrame, strength: float, tolerance: float, most_steps: int) -> DataFrame:
    """The fits of prompts whose pairs fit a task: one shuffle by prompt, all steps there, many prompts at once."""
    k = len(EXPERTS)
    x = [F.col(f"x{i}") for i in range(k)]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in x])
    rows = base.where(F.col("prompt_id").isNotNull()).select(
        "prompt_id", F.col("prompt_id").cast("string").alias("text"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"), F.col("y").isNotNull().alias("judged"),
        whole.alias("whole"), *[F.coalesce(c, F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(x)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the prompt that may go on in the next batch
        for batch in batches:
            joined = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(joined):
                continue
            ended = (joined["text"] != joined["text"].iloc[-1]).to_numpy()
            if ended.any():
                yield _fit_prompts(joined[ended], strength, tolerance, most_steps)
            held = joined[~ended]
        if held is not None and len(held):
            yield _fit_prompts(held, strength, tolerance, most_steps)

    kind = base.schema["prompt_id"].dataType.simpleString()
    fits = rows.repartition("prompt_id").sortWithinPartitions("prompt_id").mapInPandas(
        run, f"prompt_id {kind}, n bigint, pos bigint, " + ", ".join(f"c{i} double" for i in range(k)) + ", converged boolean")
    return fits.checkpoint()


def prompt_logits(base: DataFrame, strength: float, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """prompt_id, n, pos, c0..c3, converged: a balanced, intercept-free L2 logistic fit per prompt over `stored_pairs`.

    Prompts of at most GROUP_ROWS pairs are fitted where their pairs lie, larger ones by passes of partial sums. Steps go on until
    none moves a coefficient by more than `tolerance`; prompts that still move after `most_steps` are marked.
    """
    short, large = by_size(base, ["prompt_id"])
    fits = _logits_in_tasks(short, strength, tolerance, most_steps)
    return fits if large is None else fits.unionByName(_logits_by_passes(large, strength, tolerance, most_steps))


def logit_targets(pairs: DataFrame, strength: float, min_pairs: int = 6, min_auc: float = 0.55, base: DataFrame | None = None) -> DataFrame:
    """Softplus-normalized coefficients with the fit's AUC, whether it converged, and whether it is good enough."""
    fits = prompt_logits(stored_pairs(pairs) if base is None else base, strength)
    raised = [nx.softplus(F.col(f"c{i}")) for i in range(len(EXPERTS))]
    total = reduce(lambda a, b: a + b, raised) + F.lit(1e-8)
    weights = fits.select("prompt_id", "n", "converged", *[f"c{i}" for i in range(len(EXPERTS))],
                          *[(r / total).alias(w) for r, w in zip(raised, WEIGHTS)])
    margin = reduce(lambda a, b: a + b, [F.col(d) * F.col(f"c{i}") for i, d in enumerate(DZ_COLUMNS)])
    scored = pairs.join(weights, "prompt_id").withColumn("margin", margin)
    quality = auc(scored, ["prompt_id"], "margin", "y", out="auc_fit").select("prompt_id", "auc_fit")
    mean = F.lit(1.0 / len(EXPERTS))
    flat = reduce(lambda a, b: a & b, [F.abs(F.col(w) - mean) <= 1e-8 + 1e-5 * mean for w in WEIGHTS])
    good = F.col("converged") & (F.col("n") >= min_pairs) & ~flat & (F.col("auc_fit") >= min_auc)
    return weights.join(quality, "prompt_id").select("prompt_id", *WEIGHTS, "auc_fit", "converged",
                                                     F.coalesce(good, F.lit(False)).alias("good"))


def prompt_targets(pairs: DataFrame, mix: list[str] | None = None, min_pairs: int = 6) -> DataFrame:
    """prompt_id, w_*, source (mix, logit or uniform), pairs_used, auc_fit, converged.

    Given mixtures come first, then a fit with C = 5, then one with C = 1, then uniform weights. `converged` is false where a fit
    was still moving after its last step and was not used, null where none was made.
    """
    if mix and all(m in pairs.columns for m in mix):
        base = mixture_targets(pairs, mix)
    else:
        base = pairs.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("pairs_used")).select(
            "prompt_id", "pairs_used", *[F.lit(None).cast("double").alias(w) for w in WEIGHTS])
    need = pairs.join(base.where(F.col(WEIGHTS[0]).isNull()).select("prompt_id"), "prompt_id", "left_semi")
    fits, base_pairs = {}, stored_pairs(need)
    for name, strength in (("strong", 5.0), ("weak", 1.0)):
        fits[name] = logit_targets(need, strength, min_pairs, base=base_pairs).select(
            "prompt_id", *[F.col(w).alias(f"{name}_{w}") for w in WEIGHTS], F.col("auc_fit").alias(f"{name}_auc"),
            F.col("good").alias(f"{name}_good"), F.col("converged").alias(f"{name}_converged"))
    joined = base.join(fits["strong"], "prompt_id", "left").join(fits["weak"], "prompt_id", "left")
    has_mix = F.col(WEIGHTS[0]).isNotNull()
    strong, weak = F.coalesce("strong_good", F.lit(False)), F.coalesce("weak_good", F.lit(False))
    return joined.select(
        "prompt_id",
        *[F.when(has_mix, F.col(w)).when(strong, F.col(f"strong_{w}")).when(weak, F.col(f"weak_{w}"))
          .otherwise(F.lit(0.25)).alias(w) for w in WEIGHTS],
        F.when(has_mix, "mix").when(strong | weak, "logit").otherwise("uniform").alias("source"), "pairs_used",
        F.when(has_mix, F.lit(None).cast("double")).when(strong, F.col("strong_auc"))
        .otherwise(F.col("weak_auc")).alias("auc_fit"),
        F.when(~has_mix, F.col("strong_converged") & F.col("weak_converged")).alias("converged"))
