"""Leak-free splits, position debiasing, folds and batches, all ordered by md5 of the keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS
from tetrarank.functions import numeric as nx
from tetrarank.functions.text import normalized_category
from tetrarank.operators.scale import (
    UNCOUNTED_BYTES, _same, estimated_bytes, exact_quantiles, hash_digits, hash_rank, range_rank, stored, value_rank, with_group_stats)


def assign_groups(groups: DataFrame, key: list[str], strata: list[str], train: float = 0.70, val: float = 0.15,
                  seed: str = "42") -> DataFrame:
    """Distinct groups with a split: floor(train * n) train, floor(val * n) val, the rest test, per stratum."""
    if not 0.0 <= train + val <= 1.0 + 1e-9:
        raise ValueError("train and val must not exceed 1 together")
    ranked = hash_rank(groups, strata, key, "__rank", seed)
    sized = with_group_stats(ranked, strata, [F.count(F.lit(1)).alias("__size")])
    n_train, n_val = F.floor(F.lit(train) * F.col("__size")), F.floor(F.lit(val) * F.col("__size"))
    split = (F.when(F.col("__rank") <= n_train, "train")
             .when(F.col("__rank") <= n_train + n_val, "val").otherwise("test"))
    return sized.withColumn("split", split).drop("__rank", "__size")


def split_by_group(df: DataFrame, key: list[str], strata: list[str] | None = None, train: float = 0.70,
                   val: float = 0.15, seed: str = "42") -> DataFrame:
    """All rows of a group get one split. A group seen in several strata is allotted by its first stratum."""
    strata = strata or []
    if strata:
        groups = df.groupBy(*key).agg(F.min(F.struct(*strata)).alias("__s")).select(
            *key, *[F.col("__s")[s].alias(s) for s in strata])
    else:
        groups = df.select(*key).distinct()
    assigned = assign_groups(groups, key, strata, train, val, seed).select(*key, "split")
    return df.drop("split").join(assigned, key)


def split_integrity(df: DataFrame, key: list[str]) -> DataFrame:
    """Groups that appear in more than one split; empty when the split is leak-free."""
    return df.groupBy(*key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.80, val: float = 0.10,
                     seed: str = "42") -> DataFrame:
    """Row-wise split with the same shares in every label."""
    return assign_groups(df, [key], [label], train, val, seed)


def flipped(df: DataFrame, flip, *, a: str = "movieA", b: str = "movieB", label: str = "y") -> DataFrame:
    """Swap the two items, negate the differences and invert the label where `flip` holds."""
    dz = [c for c in df.columns if c in DZ_COLUMNS or c.startswith("dz_")]
    swapped = {label: F.when(flip, 1 - F.col(label)).otherwise(F.col(label)),
               a: F.when(flip, F.col(b)).otherwise(F.col(a)), b: F.when(flip, F.col(a)).otherwise(F.col(b)),
               **{c: F.when(flip, -F.col(c)).otherwise(F.col(c)) for c in dz}}
    return df.select(*[swapped[c].alias(c) if c in swapped else F.col(c) for c in df.columns])


def balance_positions(df: DataFrame, by: list[str], key: list[str], target: float = 0.5, only_easy: bool = False,
                      seed: str = "42") -> DataFrame:
    """Flip the fewest rows per group that bring the share of y = 1 to the target, the first in md5 order.

    Counts per hash bucket tell in which bucket the last flipped row of a group lies; only the rows of that bucket are put in order.
    """
    eligible = F.col("difficulty") == "easy" if only_easy else F.lit(True)
    sizes = df.withColumn("__ok", eligible).groupBy(*by).agg(
        F.sum(F.col("__ok").cast("int")).alias("__size"), F.sum((F.col("__ok") & (F.col("y") == 1)).cast("int")).alias("__pos"))
    surplus = (F.col("__pos") - F.bround(F.lit(target) * F.col("__size"), 0)).cast("long")
    # Stored, these tables have a size that Spark knows: the rows are not shuffled by a handful of groups to meet them.
    sizes = stored(sizes.select(*[F.col(c).alias(f"__g_{c}") for c in by], surplus.alias("__surplus")), "groups")
    side = (eligible & (((F.col("y") == 1) & (F.col("__surplus") > 0)) | ((F.col("y") == 0) & (F.col("__surplus") < 0))))
    keys = df.select(*key)
    digits = hash_digits(keys.count() if estimated_bytes(keys) > UNCOUNTED_BYTES else 0)
    rows = df.join(sizes, _same("__g_", by)).drop(*[f"__g_{c}" for c in by]).withColumn("__side", F.coalesce(side, F.lit(False)))
    rows = rows.withColumn("__hash", nx.hash_text(*[F.col(c) for c in key], seed=seed)).withColumn("__bucket", nx.hash_bucket(F.col("__hash"), digits))
    counts = rows.where("__side").groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.max(F.abs("__surplus")).alias("__s"))
    counts = counts.withColumn("__upto", F.sum("__n").over(W.partitionBy(*by).orderBy("__bucket")))
    cut = counts.where((F.col("__upto") >= F.col("__s")) & (F.col("__upto") - F.col("__n") < F.col("__s"))).select(
        *[F.col(c).alias(f"__c_{c}") for c in by], F.col("__bucket").alias("__cut"), (F.col("__s") - F.col("__upto") + F.col("__n")).alias("__left"))
    rows = rows.join(stored(cut, "cuts"), _same("__c_", by), "left")
    edge = F.col("__side") & F.coalesce(F.col("__bucket") == F.col("__cut"), F.lit(False))
    clear = rows.where(~edge).withColumn("__flip", F.col("__side") & F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(True)))
    order = W.partitionBy(*by).orderBy("__hash", *key)
    inside = rows.where(edge).withColumn("__flip", F.row_number().over(order) <= F.col("__left"))
    return flipped(clear.unionByName(inside), F.col("__flip")).select(*df.columns)


def shuffle_positions(df: DataFrame, key: list[str], probability: float = 0.5, scope: str = "all",
                      only_easy: bool = False, seed: str = "42") -> DataFrame:
    """Flip each row with the given probability; scope `none`, `train` or `all`, optionally easy rows only."""
    if scope == "none":
        return df
    chosen = nx.hash_uniform(*[F.col(c) for c in key], seed=seed) < probability
    if scope == "train":
        chosen = chosen & (F.col("split") == "train")
    if only_easy:
        chosen = chosen & (F.col("difficulty") == "easy")
    return flipped(df, F.coalesce(chosen, F.lit(False)))


def entropy_bins(df: DataFrame, value: str, n_bins: int = 5, out: str = "entropy_bin") -> DataFrame:
    """Quantile bins, right-closed, repeated edges merged; a single distinct value is bin 0."""
    probs = {f"__e{i}": i / n_bins for i in range(n_bins + 1)}
    edges = exact_quantiles(df, [], value, probs).select(F.array_distinct(F.array(*probs)).alias("e")).scalar()
    marked = df.withColumn("__edges", edges)
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda e: F.col(value) > e))
    return marked.withColumn(out, F.when(F.size("__edges") <= 2, 0).otherwise(above)).drop("__edges")


def _fold_of(loads: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Fold of the index-th of equally large categories, each going to the fold with the fewest rows, the first of equals.

    Fold f takes its i-th one when it holds loads[f] + i * size rows, so the index-th smallest of these numbers is sought.
    `loads` is (rows, folds), `size` and `index` are per row.
    """
    def upto(level: np.ndarray) -> np.ndarray:
        return np.where(loads <= level[:, None], (level[:, None] - loads) // size[:, None] + 1, 0)

    low, high = loads.min(axis=1), loads.min(axis=1) + size * (index + 1)
    while (low < high).any():
        middle = (low + high) // 2
        enough = upto(middle).sum(axis=1) > index
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    here = (loads <= low[:, None]) & ((low[:, None] - loads) % size[:, None] == 0)
    place = index - upto(low - 1).sum(axis=1)
    return (here.cumsum(axis=1) == place[:, None] + 1).argmax(axis=1)


def fold_of_categories(df: DataFrame, category: str, n_folds: int) -> DataFrame:
    """Fold per category: categories by descending size, each to the fold with the fewest rows so far.

    Where a category goes depends on the sizes only, so the walk is over distinct sizes with their number of categories. There are
    fewer than sqrt(2 * rows) of them, and that table is all that reaches the driver; a category finds its own
    fold from the loads before its size and its place among the categories of that size.
    """
    named = df.withColumn("__category", F.coalesce(F.col(category), F.lit("unknown")))
    sizes = named.groupBy("__category").agg(F.count(F.lit(1)).alias("n"))
    loads, before, steps = np.zeros(n_folds, np.int64), 0, []
    for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect():
        steps.append((r["n"], before, loads.tolist()))
        loads, before = loads + r["n"] * _given(loads, r["n"], r["m"]), before + r["m"]
    walked = df.sparkSession.createDataFrame(steps, "s long, before long, loads array<long>")

    @F.pandas_udf("long")
    def fold(held: pd.Series, size: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series(_fold_of(np.array(held.tolist(), np.int64).reshape(len(held), -1), size.to_numpy(), index.to_numpy()))

    ranked = value_rank(sizes, [], "n", ["__category"], "__rank", resolution=1.0)
    folds = ranked.join(walked, F.col("n") == F.col("s")).select("__category", fold("loads", "n", F.col("__rank") - 1 - F.col("before")).alias("fold"))
    return named.join(folds, "__category").drop("__category")


def _given(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of `count` categories of one size each fold takes."""
    low, high = int(loads.min()), int(loads.min()) + size * count
    while low < high:
        middle = (low + high) // 2
        taken = np.where(loads <= middle, (middle - loads) // size + 1, 0).sum()
        low, high = (low, middle) if taken >= count else (middle + 1, high)
    sure = np.where(loads <= low - 1, (low - 1 - loads) // size + 1, 0)
    here = (loads <= low) & ((low - loads) % size == 0)
    return sure + (here & (here.cumsum() <= count - sure.sum()))


def fold_by_rank(df: DataFrame, key: list[str], strata: list[str], n_folds: int, seed: str = "42") -> DataFrame:
    """Fold = md5 rank within the stratum, modulo the number of folds."""
    ranked = hash_rank(df, strata, key, "__rank", seed)
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(n_folds)).cast("long")).drop("__rank")


def assign_folds(df: DataFrame, key: list[str], category: str, entropy_bin: str, n_folds: int = 5,
                 seed: str = "42") -> DataFrame:
    """By category when there are at least n_folds of them, else stratified by entropy bin, else plain."""
    distinct = df.agg(F.countDistinct(F.coalesce(F.col(category), F.lit("unknown"))).alias("c"),
                      F.countDistinct(entropy_bin).alias("b")).first()
    if distinct["c"] >= n_folds:
        return fold_of_categories(df, category, n_folds)
    return fold_by_rank(df, key, [entropy_bin] if distinct["b"] > 1 else [], n_folds, seed)


def batch_sizes(total: int, smallest: int, largest: int) -> tuple[int, int, int]:
    """(full batches of `largest`, size of the batch before the last, size of the last) for `total` items.

    Batches hold `largest` items; when fewer than `smallest` would remain, the batch before the last
    shrinks, but not below `smallest`, to leave more for the last.
    """
    if smallest <= 0 or largest <= 0 or smallest > largest:
        raise ValueError("need 0 < smallest <= largest")
    full, tail = divmod(total, largest)
    if tail == 0 or full == 0 or tail >= smallest:
        return full, 0, tail
    before = max(smallest, largest + tail - smallest)
    return full - 1, before, largest + tail - before


def batches(prompts: DataFrame, key: str, smallest: int, largest: int) -> DataFrame:
    """Adds batch (0-based) to prompts taken in md5 order of their key."""
    ranked = hash_rank(prompts, [], [key], "__n")
    total = prompts.count()
    full, before, _ = batch_sizes(total, smallest, largest)
    position = F.col("__n") - 1
    head = full * largest
    number = (F.when(position < head, F.floor(position / largest))
              .when((position < head + before) & F.lit(before > 0), F.lit(full))
              .otherwise(F.lit(full + (1 if before else 0))))
    return ranked.withColumn("batch", number.cast("long")).drop("__n")


def prompt_batch_size(prompts: DataFrame, text: str, key: str, most: int = 5) -> int:
    """Batch size from the average token estimate of the first five prompts by key: the longer the prompts,
    the fewer per batch."""
    from tetrarank.functions.text import token_estimate
    sample = prompts.orderBy(key).limit(5).agg(
        F.avg(token_estimate(F.col(text))).alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    if not sample["n"]:
        return 0
    size = most if sample["tokens"] < 80 else max(2, most - 1) if sample["tokens"] < 100 else max(1, most - 2)
    return prompts.limit(size).count()  # no more than there are prompts


def level_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, level, place: the distinct levels of each column, `unknown` first, then in order of their text."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), normalized_category(F.col(c)).alias("level")) for c in columns]))
    found = df.select(entries.alias("e")).select("e.*").distinct()
    always = df.sparkSession.createDataFrame([(c, "unknown") for c in columns], "column string, level string")
    every = found.where("level <> 'unknown'").unionByName(always).withColumn("known", (F.col("level") != "unknown").cast("int"))
    ranked = range_rank(every, ["column"], ["known", "level"], "place")
    return ranked.select("column", "level", (F.col("place") - 1).alias("place"))


def sparse_design(df: DataFrame, levels: DataFrame, columns: list[str], numeric: list[str], key: str = "prompt_id") -> DataFrame:
    """key, size, indices, values: the wide design as sparse rows, for any number of levels.

    The flags of the columns lie one after the other in the given order, each in the order of its places, then the numeric
    columns by name with nulls as 0 (zeros are left out). Neither the levels nor a column per level enter the plan.
    """
    width = levels.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["column"]: r["n"] for r in width.collect()}  # a row per column
    start, at = {}, 0
    for c in columns:
        start[c], at = at, at + sizes[c]
    first = F.create_map(*[F.lit(x) for c in columns for x in (c, start[c])])
    flags = one_hot_entries(df, levels, columns, key).select(key, (first[F.col("column")] + F.col("place")).alias("i"), F.lit(1.0).alias("x"))
    entries = flags
    if numeric:
        value = [F.struct(F.lit(at + i).cast("bigint").alias("i"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")) for i, c in enumerate(sorted(numeric))]
        entries = flags.unionByName(df.select(key, F.explode(F.array(*value)).alias("e")).select(key, "e.*").where("x <> 0"))
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"))
    return rows.select(key, F.lit(at + len(numeric)).cast("bigint").alias("size"), F.col("e.i").alias("indices"), F.col("e.x").alias("values"))


def one_hot_entries(df: DataFrame, levels: DataFrame, columns: list[str], key: str = "prompt_id") -> DataFrame:
    """key, column, level, place: the one flag that is set per row and column; levels not in the table are `unknown`.

    The long form of the design for any number of levels; `one_hot` makes a column per level.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), normalized_category(F.col(c)).alias("seen")) for c in columns]))
    rows = df.select(key, entries.alias("e")).select(key, "e.*")
    known = levels.select(F.col("column").alias("__c"), F.col("level").alias("__l"), "place")
    joined = rows.join(known, (F.col("column") == F.col("__c")) & (F.col("seen") == F.col("__l")), "left")
    return joined.select(key, "column", F.coalesce("__l", F.lit("unknown")).alias("level"), F.coalesce("place", F.lit(0)).alias("place"))


def fit_levels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted category levels per column, `unknown` first: the column names of the wide design."""
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in level_table(df, columns).orderBy("column", "place").toLocalIterator():
        levels[r["column"]].append(r["level"])
    return levels


def one_hot(df: DataFrame, levels: dict[str, list[str]], numeric: list[str], key: str = "prompt_id") -> DataFrame:
    """key, X_{column}__{level} flags in level order, then X_{numeric} with nulls as 0."""
    import re
    out = [F.col(key)]
    for c, values in levels.items():
        for v in values:
            name = re.sub("[^a-z0-9]+", "_", v).strip("_") or "unknown"
            out.append((normalized_category(F.col(c)) == v).cast("double").alias(f"X_{c}__{name}"))
    for c in sorted(numeric):
        value = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        out.append(value.alias(f"X_{c}"))
    return df.select(*out)


