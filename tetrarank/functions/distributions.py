"""Discrete distributions held in array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tetrarank.constants import EMOTIONS
from tetrarank.functions.vectors import as_double, dot, let, norm, total


def uniform(n: int = len(EMOTIONS)) -> Column:
    return F.array(*[F.lit(1.0 / n)] * n)


def _raised(v: Column, floor: float = 0.0) -> Column:
    return F.transform(as_double(v), lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(floor)))


def simplex(v: Column, n: int = len(EMOTIONS)) -> Column:
    """Negatives to zero, then divide by the sum; uniform when nothing is left or the size is wrong."""
    def divided(clipped: Column) -> Column:
        return let(total(clipped), lambda s: F.when(
            (F.size(clipped) == n) & (s > 0) & ~F.isnan(s) & (s < float("inf")),
            F.transform(clipped, lambda x: x / s)).otherwise(uniform(n)))

    return F.coalesce(let(_raised(v), divided), uniform(n))


def smoothed_simplex(v: Column, epsilon: float = 1e-9) -> Column:
    """(max(0, x) + epsilon) / sum; an all-zero vector becomes uniform."""
    raised = F.transform(_raised(v), lambda x: x + epsilon)
    return let(raised, lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s)))


def _plogp(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a * (F.ln(a) - F.ln(b))))


def js_similarity(p: Column, q: Column, mode: str = "sqrt") -> Column:
    """Jensen-Shannon similarity.

    `sqrt`: 1 - sqrt(JSD) clipped to [0, 1], entries floored at 1e-12.
    `norm`: 1 - JSD / ln 2 with 1e-10 added inside the logarithms.
    """
    if mode == "sqrt":
        def term(a: Column, b: Column) -> Column:
            mean = (a + b) * 0.5
            return (a * (F.ln(a) - F.ln(mean)) + b * (F.ln(b) - F.ln(mean))) * 0.5

        jsd = total(F.zip_with(_raised(p, 1e-12), _raised(q, 1e-12), term))
        sim = F.lit(1.0) - F.sqrt(F.greatest(jsd, F.lit(0.0)))
        return F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0))
    if mode == "norm":
        def part(a: Column, b: Column) -> Column:
            mean = (a + b) * 0.5 + 1e-10
            return (a * F.ln((a + 1e-10) / mean) + b * F.ln((b + 1e-10) / mean)) * 0.5

        return F.lit(1.0) - total(F.zip_with(as_double(p), as_double(q), part)) / F.lit(math.log(2.0))
    raise ValueError(f"unknown mode {mode!r}")


def kl_divergence(p: Column, q: Column, eps: float = 1e-8) -> Column:
    a = F.transform(as_double(p), lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))
    b = F.transform(as_double(q), lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))
    return _plogp(a, b)


def l1_distance(p: Column, q: Column) -> Column:
    return total(F.zip_with(as_double(p), as_double(q), lambda x, y: F.abs(x - y)))


def weight_cosine(p: Column, q: Column) -> Column:
    return dot(p, q) / (norm(p) * norm(q) + F.lit(1e-9))


def entropy(v: Column, floor: float = 1e-9) -> Column:
    """Entropy in nats, entries floored."""
    return -total(F.transform(_raised(v, floor), lambda x: x * F.ln(x)))


def entropy_bits(v: Column) -> Column:
    """Entropy in bits of the normalized weights."""
    normal = let(total(v) + F.lit(1e-9), lambda s: F.transform(as_double(v), lambda x: x / s))
    return entropy(normal) / F.lit(math.log(2.0))


def softmax(v: Column, temperature: float = 1.0, eps: float = 0.0) -> Column:
    scaled = F.transform(as_double(v), lambda x: x / temperature)
    exps = let(scaled, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return let(exps, lambda e: let(total(e) + F.lit(eps), lambda s: F.transform(e, lambda x: x / s)))


def argmax(v: Column) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(as_double(v), F.array_max(as_double(v))) - 1).cast("int")
