"""Pairwise evaluation: agreement, AUC, slices, gating sweeps, prompt-level features and reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS, EXPERTS, TIE_TOLERANCE
from tetrarank.functions import numeric as nx
from tetrarank.operators.scale import _same, by_size, exact_quantiles, running_totals
from tetrarank.functions.numeric import value_bucket


def agreement_counts() -> list[Column]:
    """Counts and accuracies from an `agree` column of +1, -1 and 0."""
    pos = F.sum((F.col("agree") == 1).cast("long"))
    neg = F.sum((F.col("agree") == -1).cast("long"))
    ties = F.sum((F.col("agree") == 0).cast("long"))
    n = F.count(F.lit(1))
    return [n.alias("n"), pos.alias("correct"), neg.alias("incorrect"), ties.alias("ties"),
            (pos / F.greatest(pos + neg, F.lit(1))).alias("acc_no_ties"),
            ((pos + 0.5 * ties) / F.greatest(n, F.lit(1))).alias("acc_ties_half"),
            (ties / F.greatest(n, F.lit(1))).alias("tie_rate")]


def sliced(df: DataFrame, by: list[str], slices: list[str], aggregates: list[Column],
           drop_null_slices: bool = False) -> DataFrame:
    """Aggregates overall and per value of each slice column, in one pass over the rows.

    Result columns: by..., slice (`overall` or the column), slice_value, aggregates.
    """
    level = F.grouping_id()
    grouped = df.groupingSets([[F.col(c) for c in by], *[[F.col(c) for c in [*by, s]] for s in slices]],
                              *[F.col(c) for c in [*by, *slices]]).agg(*aggregates, level.alias("__gid"))
    every = (1 << len(slices)) - 1
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for i, s in enumerate(slices):
        here = F.col("__gid") == (every & ~(1 << (len(slices) - 1 - i)))
        name, value = F.when(here, F.lit(s)).otherwise(name), F.when(here, F.col(s).cast("string")).otherwise(value)
    names = [c for c in grouped.columns if c not in [*by, *slices, "__gid"]]
    out = grouped.select(*by, name.alias("slice"), value.alias("slice_value"), *names)
    return out.where("slice = 'overall' or slice_value is not null") if drop_null_slices else out


def agreement_report(df: DataFrame, margin: str = "margin", label: str = "y", by: list[str] | None = None,
                     slices: list[str] | None = None, tolerance: float = TIE_TOLERANCE,
                     drop_null_slices: bool = False) -> DataFrame:
    """Agreement overall and per category and difficulty."""
    marked = df.withColumn("agree", nx.agreement(F.col(margin), F.col(label), tolerance))
    return sliced(marked, by or [], slices if slices is not None else ["category", "difficulty"],
                  agreement_counts(), drop_null_slices)


def strict_metrics(df: DataFrame, margin: str = "margin", label: str = "y", by: list[str] | None = None,
                   tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Strict agreement (sign 0 is wrong), half credit for ties, mean absolute score, population std."""
    s, side = F.col(margin), F.when(F.col(label) > 0.5, 1.0).otherwise(-1.0)
    right = (F.signum(s) == side).cast("double")
    half = F.when(F.abs(s) <= tolerance, 0.5).otherwise(right)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(right).alias("agree_no_ties"), F.avg(half).alias("agree_ties_half"),
        F.avg(F.abs(s)).alias("mean_abs_score"), F.stddev_pop(s).alias("std_score"))


def unpivot_margins(df: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per model and pair: model, kept columns, margin."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("margin"))
                                  for m, c in models.items()]))
    return df.select(*keep, entries.alias("__m")).select("__m.model", *keep, "__m.margin")


def auc(df: DataFrame, by: list[str], score: str, label: str, out: str = "auc", resolution: float = 256.0) -> DataFrame:
    """Area under the ROC curve per group; equal scores share their rank, one class only gives null.

    Rows are counted per distinct score first and the running counts are taken in score buckets, so a
    single overall group is spread over many tasks.
    """
    value = F.col(score).cast("double")
    counted = df.groupBy(*by, value.alias("__s")).agg(
        F.sum((F.col(label) > 0.5).cast("long")).alias("__p"), F.sum((F.col(label) <= 0.5).cast("long")).alias("__q"))
    upto = running_totals(counted, by, [F.col("__s")], value_bucket(F.col("__s"), resolution), {"__below": F.col("__q")})
    wins = F.col("__p") * (F.col("__below") - F.col("__q") + 0.5 * F.col("__q"))
    sums = upto.groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"), F.sum(wins).alias("__wins"))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("__wins") / (F.col("n_pos") * F.col("n_neg")))
    return sums.select(*by, "n_pos", "n_neg", area.alias(out))


def fused_pair_metrics(df: DataFrame, margin: str = "margin", label: str = "y", by: list[str] | None = None) -> DataFrame:
    """Accuracy of margin > 0, log-loss with probabilities clipped at 1e-6, and AUC."""
    by = by or []
    p = nx.clip(nx.sigmoid(F.col(margin)), 1e-6, 1 - 1e-6)
    loss = -F.when(F.col(label) > 0.5, F.ln(p)).otherwise(F.ln(1.0 - p))
    hit = ((F.col(margin) > 0) == (F.col(label) > 0.5)).cast("double")
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("logloss"))
    area = auc(df, by, margin, label)
    if not by:
        return base.select("*", area.select("auc").scalar().alias("auc"))
    return base.join(area.select(*by, "auc"), by)


def ranker_report(df: DataFrame, margin: str = "margin", label: str = "y",
                  tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Accuracy without ties, tie rate and AUC overall, per category and per difficulty."""
    slices = ["category", "difficulty"]
    counts = agreement_report(df, margin, label, [], slices, tolerance)
    stacked = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(name).alias("slice"), value.cast("string").alias("slice_value"), margin, label)
        for name, value in [("overall", F.lit(None)), *[(s, F.col(s)) for s in slices]]])
    areas = auc(stacked, ["slice", "slice_value"], margin, label)
    renamed = areas.select(F.col("slice").alias("__a_slice"), F.col("slice_value").alias("__a_slice_value"), "auc")
    return counts.join(renamed, _same("__a_", ["slice", "slice_value"]), "left").drop("__a_slice", "__a_slice_value")


def gating_sweep(df: DataFrame, thresholds: list[float], weights: list[str], margin: str = "margin",
                 label: str = "y", by: list[str] | None = None, tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Per threshold: gated count and rate, agreement of gated and other rows, dominant expert counts.

    Rows are repeated per threshold in place and collapsed by partial aggregation before any shuffle.
    A threshold of 0 means no gating.
    """
    by = by or []
    largest = F.greatest(*[F.col(w) for w in weights])
    dominant = F.coalesce(*[F.when(F.col(w) == largest, F.lit(e)) for w, e in zip(weights, EXPERTS)])
    rows = df.select(*by, nx.agreement(F.col(margin), F.col(label), tolerance).alias("agree"), largest.alias("__max"),
                     dominant.alias("__dom"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    gated = (F.col("threshold") > 0) & (F.col("__max") >= F.col("threshold"))

    def half(where: Column) -> Column:
        credit = F.when(F.col("agree") == 1, 1.0).when(F.col("agree") == 0, 0.5).otherwise(0.0)
        return F.avg(F.when(where, credit))

    counts = agreement_counts()
    return rows.withColumn("__g", gated).groupBy("threshold", *by).agg(
        *counts, F.sum(F.col("__g").cast("long")).alias("gated"), F.avg(F.col("__g").cast("double")).alias("gating_rate"),
        half(F.col("__g")).alias("gated_agree"), half(~F.col("__g")).alias("other_agree"),
        *[F.sum((F.col("__g") & (F.col("__dom") == e)).cast("long")).alias(f"dominant_{e}") for e in EXPERTS])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest agreement, the lowest threshold among equals."""
    return sweep.orderBy(F.desc(F.round("acc_ties_half", 12)), "threshold").limit(1)


def weight_report(df: DataFrame, weights: list[str], by: list[str] | None = None) -> DataFrame:
    """Per expert: mean, population std, min, max weight, and how often it is the largest."""
    by = by or []
    largest = F.greatest(*[F.col(w) for w in weights])
    dominant = F.coalesce(*[F.when(F.col(w) == largest, F.lit(e)) for w, e in zip(weights, EXPERTS)])
    entries = F.explode(F.array(*[F.struct(F.lit(e).alias("expert"), F.col(w).alias("weight"))
                                  for w, e in zip(weights, EXPERTS)]))
    rows = df.select(*by, dominant.alias("__dom"), entries.alias("__e")).select(*by, "__dom", "__e.*")
    return rows.groupBy(*by, "expert").agg(
        F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("std_weight"),
        F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
        F.sum((F.col("__dom") == F.col("expert")).cast("long")).alias("selected"))


def prompt_design(pairs: DataFrame, categories: list[str], flags: list[str], levels: list[str],
                  key: str = "pair_id") -> DataFrame:
    """One feature row per prompt: first categories, difficulty shares, counts, flag means, dz statistics.

    Prompts of at most GROUP_ROWS pairs meet in one task, where all of this is one aggregate. For larger ones means and deviations are
    partial aggregates and quantiles come from running counts, so their rows are never gathered in one buffer.
    """
    from tetrarank.functions.text import normalized_category
    difficulty = normalized_category(F.col("difficulty"))
    shares = {lvl: F.avg((difficulty == lvl).cast("double")) for lvl in levels if lvl != "unknown"}
    known = reduce(lambda a, b: a + b, shares.values())
    shares["unknown"] = F.greatest(F.lit(1.0) - known, F.lit(0.0))
    aggregates = [F.count(F.lit(1)).cast("double").alias("pairs_per_prompt"),
                  F.avg(F.col("y").cast("double")).alias("share_positive_pairs")]
    aggregates += [normalized_category(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key)))).alias(c) for c in categories]
    aggregates += [F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in flags]
    aggregates += [s.alias(f"difficulty_frac_{lvl}") for lvl, s in shares.items()]
    for d in DZ_COLUMNS:
        x = F.col(d).cast("double")
        aggregates += [F.avg(x).alias(f"{d}_mean"), F.stddev_pop(x).alias(f"{d}_std"),
                       F.avg((x > 0).cast("double")).alias(f"{d}_pos_frac")]
    probs = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    used = list(dict.fromkeys(["prompt_id", "y", "difficulty", *([key] if categories else []), *categories, *flags, *DZ_COLUMNS]))
    short, large = by_size(pairs.where(F.col("prompt_id").isNotNull()).select(*used), ["prompt_id"])
    values = [F.sort_array(F.collect_list(F.col(d).cast("double"))).alias(f"__v_{d}") for d in DZ_COLUMNS]
    # Dealt by prompt before the aggregate: its buffers are far larger than the few rows of a prompt.
    out = short.repartition("prompt_id").groupBy("prompt_id").agg(*aggregates, *values)
    out = out.where(reduce(lambda a, b: a | b, [F.size(f"__v_{d}") > 0 for d in DZ_COLUMNS]))
    quantiles = []
    for d in DZ_COLUMNS:
        v = F.col(f"__v_{d}")
        for name, p in probs.items():
            position = (F.size(v) - 1) * F.lit(p)
            low, high = F.get(v, F.floor(position).cast("int")), F.get(v, F.ceil(position).cast("int"))
            quantiles.append((low + (high - low) * (position - F.floor(position))).alias(f"{d}_{name}"))
    out = out.select(*[c for c in out.columns if not c.startswith("__v_")], *quantiles)
    if large is not None:
        entries = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("double").alias("x")) for d in DZ_COLUMNS]))
        long = large.select("prompt_id", entries.alias("e")).select("prompt_id", "e.*")
        found = exact_quantiles(long, ["prompt_id", "d"], "x", probs)
        wide = found.groupBy("prompt_id").agg(*[F.max(F.when(F.col("d") == d, F.col(q))).alias(f"{d}_{q}") for d in DZ_COLUMNS for q in probs])
        out = out.unionByName(large.groupBy("prompt_id").agg(*aggregates).join(wide, "prompt_id"))
    ordered = F.array(*[F.struct(F.col(f"difficulty_frac_{lvl}").alias("s"), F.lit(-i).alias("i"), F.lit(lvl).alias("l"))
                        for i, lvl in enumerate(shares)])
    return out.withColumn("difficulty_primary", F.array_max(ordered)["l"])


def weight_distances(df: DataFrame, truth: list[str], predicted: list[str], slices: list[str]) -> DataFrame:
    """Mean KL, L1 and cosine between true and predicted weights, overall and per slice."""
    from tetrarank.functions import distributions as dx
    p, q = F.array(*[F.col(c) for c in truth]), F.array(*[F.col(c) for c in predicted])
    rows = df.withColumns({"__kl": dx.kl_divergence(p, q), "__l1": dx.l1_distance(p, q), "__cos": dx.weight_cosine(p, q)})
    return sliced(rows, [], slices, [F.count(F.lit(1)).alias("n"), F.avg("__kl").alias("kl"), F.avg("__l1").alias("l1"),
                                     F.avg("__cos").alias("cosine")])


def fold_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population std of each metric over folds."""
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return metrics.select(entries.alias("m")).select("m.*").groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def loss_report(df: DataFrame, margin: str, label: str, weights: list[str], by: list[str] | None = None, *,
                focal_gamma: float = 2.0, band: float = 0.5, entropy_target: float = 1.0, entropy_min: float = 0.6,
                gate_threshold: float = 0.75, gate_strength: float = 0.1) -> DataFrame:
    """Mean pair losses and weight regularizers."""
    from tetrarank.functions import distributions as dx
    s, y = F.col(margin), F.col(label)
    w = F.array(*[F.col(c) for c in weights])
    nats = dx.entropy(w, floor=1e-8)
    plain = -reduce(lambda a, b: a + b, [F.col(c) * F.ln(F.col(c) + 1e-10) for c in weights])
    gate = nx.sigmoid((F.array_max(w) - gate_threshold) * 10.0)
    entropy_floored = -reduce(lambda a, b: a + b, [F.col(c) * F.ln(F.greatest(F.col(c), F.lit(1e-8))) for c in weights])
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(nx.pair_loss(s, y)).alias("btl"),
        F.avg(nx.pair_loss(s, y, focal_gamma)).alias("focal"),
        F.avg(F.greatest(F.lit(band) - F.abs(s), F.lit(0.0))).alias("margin_push"),
        F.greatest(F.avg(nats) - entropy_target, F.lit(0.0)).alias("entropy_hinge"),
        F.avg(F.greatest(F.lit(entropy_min) - plain, F.lit(0.0))).alias("low_entropy_penalty"),
        (F.avg(gate * entropy_floored / F.lit(math.log(4.0))) * gate_strength).alias("gating_penalty"))


def outcome_labels(df: DataFrame, margin: str | None = "margin", label: str = "y",
                   tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Adds prediction (mean of experts when no margin is given), agreement and outcome."""
    prediction = F.col(margin) if margin and margin in df.columns else (
        reduce(lambda a, b: a + b, [F.col(c) for c in DZ_COLUMNS]) / len(DZ_COLUMNS))
    marked = df.withColumn("prediction", prediction)
    marked = marked.withColumn("agreement", nx.agreement(F.col("prediction"), F.col(label), tolerance))
    return marked.withColumn("outcome", F.when(F.col("agreement") == 1, "correct")
                             .when(F.col("agreement") == -1, "incorrect").otherwise("tie"))


def expert_disagreements(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose expert signs differ, with counts of positive, negative and zero signs."""
    columns = columns or DZ_COLUMNS
    signs = F.array(*[F.signum(c).cast("int") for c in columns])

    def count_of(value: int) -> Column:
        return F.size(F.filter(signs, lambda s: s == value))

    rows = df.withColumns({"num_positive": count_of(1), "num_negative": count_of(-1), "num_zero": count_of(0)})
    return rows.where(F.size(F.array_distinct(signs)) > 1)


def mixture_only_failures(df: DataFrame, margin: str, label: str = "y", columns: list[str] | None = None,
                          tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Rows the mixture gets wrong although at least one expert is right."""
    columns = columns or DZ_COLUMNS
    marked = df.withColumn("moe_agreement", nx.agreement(F.col(margin), F.col(label), tolerance))
    marked = marked.withColumns({f"{c}_agreement": nx.agreement(F.col(c), F.col(label), tolerance) for c in columns})
    any_right = reduce(lambda a, b: a | b, [F.col(f"{c}_agreement") == 1 for c in columns])
    return marked.where((F.col("moe_agreement") == -1) & any_right)


def case_studies(failures: DataFrame, by: str = "category", key: str = "pair_id", per_group: int = 2,
                 seed: str = "42") -> DataFrame:
    """A few failures per category in md5 order."""
    from tetrarank.operators.scale import top_k
    hashed = nx.hash_text(F.col(key), seed=seed)
    return top_k(failures.withColumn("__h", hashed), [by], [F.col("__h"), F.col(key)], per_group, rank="case_no").drop("__h")
