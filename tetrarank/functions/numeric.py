"""Scalar numeric expressions: signs, losses, hashing, margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS, TIE_TOLERANCE


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pair_loss(margin: Column, y: Column, focal_gamma: float = 0.0) -> Column:
    """softplus(-margin) for y=1, softplus(margin) for y=0, optionally focal."""
    loss = F.when(y > 0.5, softplus(-margin)).otherwise(softplus(margin))
    if focal_gamma > 0.0:
        p = sigmoid(margin)
        pt = clip(F.when(y > 0.5, p).otherwise(1.0 - p), 1e-6, 1 - 1e-6)
        loss = loss * F.pow(1.0 - pt, F.lit(focal_gamma))
    return loss


def agreement(margin: Column, y: Column, tolerance: float = TIE_TOLERANCE) -> Column:
    """+1 right, -1 wrong, 0 tie (|margin| <= tolerance)."""
    sign = F.when(F.abs(margin) <= tolerance, 0).when(margin > 0, 1).otherwise(-1)
    return sign * F.when(y > 0.5, 1).otherwise(-1)


def weighted_margin(weights: list[Column], signals: list[Column]) -> Column:
    out = weights[0] * signals[0]
    for w, s in zip(weights[1:], signals[1:]):
        out = out + w * s
    return out


def expert_columns(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{e}") for e in EXPERTS]


def hash_text(*parts, seed: str = "42") -> Column:
    """md5 of seed and key parts: an order that no partitioning or engine can change."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                                 for p in parts]))


def hash_uniform(*parts, seed: str = "42") -> Column:
    """Uniform number in [0, 1) from the first eight hex digits of `hash_text`."""
    return F.conv(F.substring(hash_text(*parts, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(hashed: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits as an integer; ascends with the hash text."""
    return F.conv(F.substring(hashed, 1, hex_digits), 16, 10).cast("int" if hex_digits < 8 else "bigint")


def value_bucket(value: Column, resolution: float = 256.0) -> Column:
    """Ascending integer bucket of a number: even steps near zero, logarithmic ones far from it, so no
    range of values ends up in one bucket. Null comes first and NaN last, as in a sort."""
    scaled = value * F.lit(float(resolution))
    size = F.abs(scaled)
    even = 16384.0
    step = F.when(size <= even, size).otherwise(F.lit(even) + F.log2(size / even) * 256.0)
    bucket = F.when(F.isnan(value) | (size == float("inf")), F.when(value < 0, -(2 ** 29)).otherwise(2 ** 29)).otherwise(
        F.floor(F.when(scaled < 0, -step).otherwise(step)).cast("int"))
    return F.coalesce(bucket, F.lit(-(2 ** 30)))


def group_setting(spec: str, group: Column, default: float) -> Column:
    """Value for a group from a text such as `easy:0.65,medium:1.0`."""
    if not spec.strip():
        return F.lit(float(default))
    settings = F.str_to_map(F.lit(spec.replace(" ", "").lower()), F.lit(","), F.lit(":"))
    found = F.try_element_at(settings, F.lower(F.trim(F.coalesce(group, F.lit("")))))
    return F.coalesce(found.try_cast("double"), F.lit(float(default)))


def calibrated_margin(margin: Column, group: Column, scale: str = "", bias: str = "") -> Column:
    return margin * group_setting(scale, group, 1.0) + group_setting(bias, group, 0.0)


def pair_confidence(gap: Column, difficulty: Column) -> Column:
    """Confidence of a judgment from the absolute score gap, by difficulty."""
    step = F.least(F.abs(gap) / 0.5, F.lit(1.0))
    value = (F.when(difficulty == "easy", 0.8 + 0.2 * step)
             .when(difficulty == "medium", 0.5 + 0.3 * step)
             .otherwise(0.4 + 0.2 * step))
    return F.round(F.least(value, F.lit(1.0)), 3)


def hardness(diffs: list[Column], weights: list[Column]) -> Column:
    """1 minus the weighted absolute signal differences, clipped to [0, 1]."""
    spread = weighted_margin([F.abs(d) for d in diffs], weights)
    return clip(F.lit(1.0) - spread, 0.0, 1.0)


def top_signals(diffs: list[Column], weights: list[Column], names: list[str]) -> Column:
    """Names of the two signals that differ most after weighting; the first name when none differs."""
    entries = F.array(*[
        F.struct((-F.abs(d) * w).alias("neg"), F.lit(i).alias("pos"), F.lit(n).alias("name"))
        for i, (d, w, n) in enumerate(zip(diffs, weights, names))])
    best = F.filter(F.slice(F.array_sort(entries), 1, 2), lambda s: s["neg"] < 0)
    joined = F.array_join(F.transform(best, lambda s: s["name"]), " and ")
    return F.when(joined == "", F.lit(names[0])).otherwise(joined)
