"""Preference pairs and their score-difference features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS, EXPERTS, NO_SIGNAL_TOLERANCE
from tetrarank.functions import distributions as dx
from tetrarank.functions import vectors as vx
from tetrarank.operators.scale import with_group_stats


def with_signal(df: DataFrame, columns: list[str] | None = None, tolerance: float = NO_SIGNAL_TOLERANCE) -> DataFrame:
    """Rows whose differences are all present and not all within the tolerance."""
    columns = columns or DZ_COLUMNS
    return df.dropna(subset=columns).where(F.greatest(*[F.abs(c) for c in columns]) > tolerance)


def difference_features(pairs: DataFrame, scored: DataFrame, *, query_id: str = "prompt_id", a: str = "movieA",
                        b: str = "movieB", item_id: str = "item_id", z: str = "z_") -> DataFrame:
    """dz_* = z of item A minus z of item B for pairs whose two items were both retrieved.

    Both lookups share the key (prompt, item), so a frequent prompt is spread over its items.
    """
    zs = [f"{z}{e}" for e in EXPERTS]
    left = scored.select(query_id, F.col(item_id).alias(a), *[F.col(c).alias(f"__a{c}") for c in zs])
    right = scored.select(query_id, F.col(item_id).alias(b), *[F.col(c).alias(f"__b{c}") for c in zs])
    joined = pairs.join(left, [query_id, a]).join(right, [query_id, b])
    differences = [(F.col(f"__a{c}") - F.col(f"__b{c}")).alias(d) for c, d in zip(zs, DZ_COLUMNS)]
    kept = [c for c in pairs.columns if c not in DZ_COLUMNS]
    return with_signal(joined.select(*kept, *differences))


def judged_pairs(pairs: DataFrame, judgments: DataFrame, prompts: DataFrame) -> DataFrame:
    """pairs with their label (inner) and prompt attributes (left)."""
    return (pairs.join(judgments.select("prompt_id", "pair_id", "y"), ["prompt_id", "pair_id"])
            .join(prompts, "prompt_id", "left"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for a valid one-to-one side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_keys(left: list[str], right: list[str]) -> list[str]:
    for keys in (["prompt_id", "pair_id"], ["prompt_id", "movieA", "movieB"]):
        if all(k in left and k in right for k in keys):
            return keys
    raise ValueError("both sides need prompt_id with pair_id or with movieA and movieB")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Inner join that fails when a key repeats on either side.

    The check is part of the same job: a repeated key raises while its rows are being counted.
    """
    if not check:
        return left.join(right, keys)

    def unique(df: DataFrame, side: str) -> DataFrame:
        # The error text must not depend on the row, or Spark would evaluate it for every row.
        fail = F.raise_error(F.lit(f"repeated key {keys} on the {side} side"))
        counted = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))  # in the shuffle and sort of the join itself
        return counted.where(F.when(F.col("__n") > 1, fail.cast("boolean")).otherwise(F.lit(True))).drop("__n")

    return unique(left, "left").join(unique(right, "right"), keys)


def prefixed_differences(df: DataFrame, prefix: str) -> DataFrame:
    """dz_* renamed to {prefix}_dz_* unless those exist; absent columns become 0."""
    wanted = [f"{prefix}_{c}" for c in DZ_COLUMNS]
    if all(c in df.columns for c in wanted):
        return df
    if all(c in df.columns for c in DZ_COLUMNS):
        return df.withColumnsRenamed(dict(zip(DZ_COLUMNS, wanted)))
    return df.withColumns({c: F.lit(0.0) for c in wanted if c not in df.columns})


def evidence_shapes(prefix: str) -> list[Column]:
    """Shape statistics of one difference vector: norms, extremes, sums, entropy, concentration."""
    v = F.array(*[F.col(f"{prefix}_{c}").cast("double") for c in DZ_COLUMNS])
    magnitudes = F.transform(v, lambda x: F.abs(x))
    l1 = vx.total(magnitudes)
    share = vx.let(F.greatest(l1, F.lit(1e-9)), lambda s: F.transform(
        magnitudes, lambda x: F.greatest(x / s, F.lit(1e-12))))
    return [
        l1.alias(f"{prefix}_l1_abs"),
        F.sqrt(vx.dot(v, v) + F.lit(1e-12)).alias(f"{prefix}_l2"),
        F.array_max(magnitudes).alias(f"{prefix}_max_abs"),
        dx.argmax(magnitudes).alias(f"{prefix}_argmax_abs"),
        vx.total(F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))).alias(f"{prefix}_pos_sum"),
        vx.total(F.transform(v, lambda x: F.greatest(-x, F.lit(0.0)))).alias(f"{prefix}_neg_sum"),
        dx.entropy(share, floor=1e-12).alias(f"{prefix}_entropy"),
        (F.array_max(magnitudes) / F.greatest(l1, F.lit(1e-9))).alias(f"{prefix}_concentration"),
    ]


def cross_family(left: str = "attn", right: str = "sum") -> list[Column]:
    """Dot, cosine and per-expert deltas between two families of differences."""
    a = F.array(*[F.col(f"{left}_{c}").cast("double") for c in DZ_COLUMNS])
    b = F.array(*[F.col(f"{right}_{c}").cast("double") for c in DZ_COLUMNS])
    product = vx.dot(a, b)
    lengths = F.sqrt(vx.dot(a, a) + F.lit(1e-12)) * F.sqrt(vx.dot(b, b) + F.lit(1e-12))
    deltas = [(F.col(f"{left}_dz_{e}") - F.col(f"{right}_dz_{e}")).alias(f"delta_dz_{e}") for e in EXPERTS]
    return [product.alias(f"sim_{left}_{right}_dot"), (product / lengths).alias(f"sim_{left}_{right}_cos"), *deltas]


def canonical_family(signal: Column, prefer: str = "attn", fallback: str = "sum") -> list[Column]:
    """dz_* taken from the preferred family, or from the other one when the preferred has no signal anywhere."""
    return [F.when(signal, F.col(f"{prefer}_{c}")).otherwise(F.col(f"{fallback}_{c}")).alias(c) for c in DZ_COLUMNS]


def has_signal(family: DataFrame, prefix: str) -> Column:
    """Whether any difference of a family is not zero, taken from its own table before any join."""
    mass = reduce(lambda a, b: a + b, [F.abs(f"{prefix}_{c}") for c in DZ_COLUMNS])
    return family.agg((F.coalesce(F.sum(mass), F.lit(0.0)) > 0).alias("x")).scalar()


def combined_features(sums: DataFrame, attns: DataFrame, canonical: str = "attn", check: bool = True) -> DataFrame:
    """Both feature families side by side with canonical dz_*, similarities, shapes and interactions."""
    left, right = prefixed_differences(sums, "sum"), prefixed_differences(attns, "attn")
    keys = merge_keys(left.columns, right.columns)
    right = right.select(*keys, *[f"attn_{c}" for c in DZ_COLUMNS],
                         *[c for c in right.columns if c not in left.columns and not c.startswith("attn_")])
    merged = join_one_to_one(left, right, keys, check)
    other = "sum" if canonical == "attn" else "attn"
    signal = has_signal(right if canonical == "attn" else left, canonical)
    merged = merged.select("*", *canonical_family(signal, canonical, other))
    return merged.select(
        "*", *cross_family(), *evidence_shapes("attn"), *evidence_shapes("sum"),
        (F.col("dz_alpha") * F.col("dz_delta")).alias("dz_axd"),
        (F.col("dz_alpha") * F.col("dz_beta")).alias("dz_axb"),
        (F.col("dz_beta") * F.col("dz_gamma")).alias("dz_bxg"))


def derived_signals(columns: list[str] | None = None) -> list[Column]:
    """abs, positive part, negative part and non-zero flag of each difference."""
    out = []
    for c in columns or DZ_COLUMNS:
        x = F.col(c)
        out += [F.abs(x).alias(f"abs_{c}"), F.greatest(x, F.lit(0.0)).alias(f"pos_{c}"),
                F.greatest(-x, F.lit(0.0)).alias(f"neg_{c}"),
                (F.abs(x) > 1e-9).cast("double").alias(f"hit_{c}")]
    return out


def pair_item_features(genres_a: Column, genres_b: Column, year_a: Column, year_b: Column, tokens_a: Column,
                       tokens_b: Column) -> list[Column]:
    """same_genre, same_decade (years less than ten apart) and Jaccard overlap of title tokens."""
    union = F.size(F.array_union(tokens_a, tokens_b))
    overlap = F.when(union > 0, F.size(F.array_intersect(tokens_a, tokens_b)) / union).otherwise(0.0)
    return [F.arrays_overlap(genres_a, genres_b).alias("same_genre"),
            (F.abs(year_a - year_b) < 10).alias("same_decade"), overlap.alias("keywords_overlap")]


def standardized_by_train(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """(x - mean) / std with both taken from the train rows; std 0 counts as 1."""
    train = F.col(split) == "train"
    stats = []
    for i, c in enumerate(columns):
        value = F.when(train, F.col(c))
        stats += [F.avg(value).alias(f"__mu{i}"), F.stddev_samp(value).alias(f"__sd{i}")]
    joined = with_group_stats(df, [], stats)
    for i, c in enumerate(columns):
        sd = F.when(F.col(f"__sd{i}") == 0, 1.0).otherwise(F.col(f"__sd{i}"))
        joined = joined.withColumn(c, (F.col(c) - F.col(f"__mu{i}")) / sd)
    return joined.drop(*[s for i in range(len(columns)) for s in (f"__mu{i}", f"__sd{i}")])


def nested_pairs(pairs: DataFrame, by: str = "prompt_id", key: str = "pair_id", batch: int = 1000) -> DataFrame:
    """Pairs of a prompt as one array per batch of at most `batch` pairs, in pair order.

    A prompt with more pairs gets several rows, so no array grows without bound.
    """
    from tetrarank.operators.scale import hash_rank
    fields = [c for c in pairs.columns if c != by]
    numbered = hash_rank(pairs, [by], [key], "__n")
    return (numbered.withColumn("batch", F.floor((F.col("__n") - 1) / batch)).groupBy(by, "batch")
            .agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in fields if c != key]))).alias("pairs"))
            .withColumn("n_pairs", F.size("pairs")))
