"""Dataset statistics, classifier metrics and model comparison tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS
from tetrarank.functions import vectors as vx
from tetrarank.operators.scale import exact_quantiles, top_k, with_group_stats


def pairs_per_prompt(pairs: DataFrame) -> DataFrame:
    """One row: mean, sample std, min, max and median number of pairs per prompt, and label balance."""
    sizes = pairs.groupBy("prompt_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("pos"))
    base = sizes.agg(F.sum("n").cast("long").alias("total_pairs"), F.sum("pos").alias("a_preferred"),
                     F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"),
                     F.max("n").alias("max"))
    median = exact_quantiles(sizes, [], "n", {"median": 0.5}, resolution=1.0).scalar()
    return base.select("*", median.alias("median"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts per row value and column value, 0 where a combination is absent."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0, values)


def feature_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: mean, std, min, max, quartiles, and shares of positive, negative and zero values."""
    columns = columns or DZ_COLUMNS
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                  for c in columns]))
    rows = df.select(entries.alias("e")).select("e.*").where("value is not null")
    value = F.col("value")
    base = rows.groupBy("feature").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), *[F.avg(c.cast("double")).alias(n) for n, c in (
            ("positive_ratio", value > 0), ("negative_ratio", value < 0), ("zero_ratio", value == 0))])
    return base.join(exact_quantiles(rows, ["feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "feature")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = list(combinations(columns or DZ_COLUMNS, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                                           F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs]))
    return one.select(entries.alias("e")).select("e.*")


def distinct_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Pairs and distinct prompts per slice."""
    return df.groupBy(*by).agg(F.count("pair_id").alias("num_pairs"), F.countDistinct("prompt_id").alias("num_prompts"))


def coverage(df: DataFrame, columns: list[str] | None = None, tolerance: float = 1e-8) -> DataFrame:
    """Rows with a non-zero value per column, and rows where all are zero."""
    columns = columns or DZ_COLUMNS
    return df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.sum((F.abs(c) > tolerance).cast("long")).alias(f"nonzero_{c}") for c in columns],
                  F.sum((F.greatest(*[F.abs(c) for c in columns]) <= tolerance).cast("long")).alias("all_zero"))


def manifest_histogram(pairs: DataFrame, items: DataFrame, values: Column, a: str = "movieA", b: str = "movieB",
                       item_id: str = "item_id") -> DataFrame:
    """How often each value (genre, decade) occurs among both members of all pairs.

    Uses are counted per item before the join, so a much used item joins as one row.
    """
    members = pairs.select(F.explode(F.array(F.col(a), F.col(b))).alias(item_id))
    uses = members.groupBy(item_id).agg(F.count(F.lit(1)).alias("uses"))
    return (uses.join(items.select(item_id, F.explode(values).alias("value")), item_id)
            .groupBy("value").agg(F.sum("uses").alias("n")))


def pair_diversity(pairs: DataFrame, expected: int = 18, a: str = "movieA", b: str = "movieB") -> DataFrame:
    """Per prompt: pairs, distinct items, diversity in percent, repeated items, most uses of one item."""
    members = pairs.select("prompt_id", F.explode(F.array(F.col(a), F.col(b))).alias("item"))
    uses = members.groupBy("prompt_id", "item").agg(F.count(F.lit(1)).alias("uses"))
    return uses.groupBy("prompt_id").agg(
        (F.sum("uses") / 2).cast("long").alias("total_pairs"), F.count(F.lit(1)).alias("unique_items"),
        (F.count(F.lit(1)) / F.lit(float(expected)) * 100).alias("diversity"),
        F.sum((F.col("uses") > 1).cast("long")).alias("repeated_items"), F.max("uses").alias("max_appearances"))


def diversity_summary(diversity: DataFrame) -> DataFrame:
    perfect = (F.col("diversity") == 100.0).cast("double")
    return diversity.agg(F.count(F.lit(1)).alias("n_prompts"), F.avg("diversity").alias("mean_diversity"),
                         F.sum(perfect).cast("long").alias("perfect"), (F.avg(perfect) * 100).alias("perfect_rate"))


def shares(df: DataFrame, by: list[str], failed: Column | None = None) -> DataFrame:
    """Count, percent of all rows and, given a failure condition, the failure rate per slice."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    if failed is not None:
        aggregates.append((F.avg(failed.cast("double")) * 100).alias("failure_rate"))
    counted = df.groupBy(*by).agg(*aggregates)
    return with_group_stats(counted, [], [F.sum("n").alias("__all")]).withColumn(
        "percent", F.col("n") * 100.0 / F.col("__all")).drop("__all")


# --- classifier metrics -----------------------------------------------------------------------------

def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and predicted count per class from confusion cells."""
    by_truth = cells.select(F.col("truth").alias("label"), F.col("n").alias("support"),
                            F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("right"),
                            F.lit(0).cast("long").alias("predicted"))
    by_prediction = cells.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                                 F.lit(0).cast("long").alias("right"), F.col("n").alias("predicted"))
    sums = by_truth.unionByName(by_prediction).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("right").alias("tp"), F.sum("predicted").alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select("label", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"),
                       f1.alias("f1"))


def overall_class_metrics(per_class: DataFrame) -> DataFrame:
    """Accuracy (equal to micro F1), macro and support-weighted means."""
    n = F.sum("support")
    return per_class.agg(n.alias("n"), (F.sum("tp") / n).alias("accuracy"), (F.sum("tp") / n).alias("f1_micro"),
                         F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
                         F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"))


def temperature_grid(df: DataFrame, logits: str, label: Column, low: float = 0.7, high: float = 5.0,
                     steps: int = 44, eps: float = 1e-12) -> DataFrame:
    """Mean negative log-likelihood per temperature; `label` is the 0-based class."""
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    rows = df.select(vx.as_double(F.col(logits)).alias("z"), label.cast("int").alias("l"),
                     F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("t"))
                                         for i, t in enumerate(grid)])).alias("g"))
    def probability_of_label(scaled: Column) -> Column:
        return vx.let(F.array_max(scaled), lambda top: F.exp(F.element_at(scaled, F.col("l") + 1) - top)
                      / vx.total(F.transform(scaled, lambda x: F.exp(x - top))))

    probability = vx.let(F.transform(F.col("z"), lambda x: x / F.col("g.t")), probability_of_label)
    return rows.select("g.step", F.col("g.t").alias("temperature"), (-F.ln(probability + eps)).alias("nll")).groupBy(
        "step", "temperature").agg(F.avg("nll").alias("nll"))


def best_temperature(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min_by("temperature", F.struct(F.round("nll", 12), F.col("step"))).alias("temperature"),
                    F.min("nll").alias("nll"))


# --- model comparison: rows of (model, slice, slice_value, metric columns) ----------------------------

def overall_ranking(report: DataFrame, metric: str = "acc_ties_half") -> DataFrame:
    return report.where("slice = 'overall'").orderBy(F.desc(F.round(metric, 12)), "model")


def slice_pivot(report: DataFrame, slice_name: str, values: list[str], metric: str = "acc_ties_half") -> DataFrame:
    """Models as rows, slice values as columns."""
    return report.where(F.col("slice") == slice_name).groupBy("model").pivot("slice_value", values).agg(F.max(metric))


def best_models(report: DataFrame, metric: str = "acc_ties_half") -> DataFrame:
    """Best model overall and per slice value, ties by name."""
    ranked = report.where(F.col(metric).isNotNull()).withColumn("__m", F.round(metric, 12))
    best = top_k(ranked, ["slice", "slice_value"], [F.desc("__m"), F.col("model")], 1)
    return best.select("slice", "slice_value", "model", metric)


def robustness(report: DataFrame, metric: str = "acc_ties_half") -> DataFrame:
    """Sample variance and mean of the metric across categories per model."""
    return report.where("slice = 'category'").groupBy("model").agg(
        F.var_samp(metric).alias("variance"), F.avg(metric).alias("mean_score"))


def ablation(report: DataFrame, experts: list[str], metric: str = "acc_ties_half") -> DataFrame:
    """Single experts against full mixtures, best first."""
    single = F.col("model").isin(experts)
    return report.where("slice = 'overall'").select(
        F.when(single, F.concat(F.lit("Expert_"), F.col("model"), F.lit("_only"))).otherwise(F.col("model")).alias("configuration"),
        F.when(single, "individual").otherwise("full_moe").alias("type"),
        F.when(single, F.col("model")).otherwise("all").alias("expert"), F.col(metric).alias("score"))


def relative_improvement(report: DataFrame, method: str, metrics: list[str], name: str = "method") -> DataFrame:
    """Percent gain of one method over every other; 0 where the other scores 0."""
    own = report.where(F.col(name) == method).agg(*[F.max(m).alias(m) for m in metrics])
    return report.where(F.col(name) != method).select(
        F.col(name).alias("baseline"),
        *[F.when(F.col(m) > 0, (own.select(m).scalar() - F.col(m)) / F.col(m) * 100.0).otherwise(0.0).alias(m)
          for m in metrics])


def emotion_statistics(index: DataFrame, emo: str = "emo") -> DataFrame:
    """Mean, population std and max probability per emotion."""
    from tetrarank.constants import EMOTIONS
    entries = F.explode(F.array(*[F.struct(F.lit(e).alias("emotion"), F.col(emo)[i].alias("p"))
                                  for i, e in enumerate(EMOTIONS)]))
    return index.select(entries.alias("e")).select("e.*").groupBy("emotion").agg(
        F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.max("p").alias("max"))
