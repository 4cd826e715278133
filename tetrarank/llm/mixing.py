"""Mixing sources to target weights, in DataFrame operations only.

A source's share p of all tokens is raised to an exponent and normalised. The exponent lies between 0 (all sources alike)
and 1 (as they are) and is bisected, 32 points at a time, on the table of sources until the weights reach a target entropy;
it goes up again where a source would be repeated beyond a limit. A token budget times the weights gives each source
a quota, filled by permutations of its documents: whole epochs, then the part of one that the quota still needs.

A permutation is made of blocks. Documents fall into 16^k blocks of their source by hash (k up to 4), an epoch
orders the blocks by one hash and the documents of a block by another. Start positions are the tokens of the blocks
before plus those before it in its block, so no source, however hot, is ever sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetrarank.llm.common import stored

#: A word is a run of characters other than ASCII white space.
WORDS = r"[^ \t\n\x0B\f\r]+"
POINTS, ROUNDS = 32, 5


def tokens_of(text: str = "text") -> Column:
    """Words and one closing mark; null text counts as empty."""
    return (F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)) + 1).cast("long")


def _at(shares: DataFrame, exponents: list[float], budget: float) -> list:
    """Entropy of the weights and the most repeats of a source at each exponent."""
    grid = shares.withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in exponents])))
    power = F.pow("p", F.col("x"))
    sums = grid.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(power / F.col("tokens")).alias("m"))
    return sums.select("x", (F.log("z") - F.col("x") * F.col("l") / F.col("z")).alias("entropy"), (F.lit(budget) * F.col("m") / F.col("z")).alias("repeats")).orderBy("x").collect()


def _bisected(shares: DataFrame, budget: float, holds) -> float:
    """The border between exponents for which `holds` (the lower ones) and those for which it doesn't, in 0..1."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        kept = [r["x"] for r in _at(shares, points, budget) if holds(r)]
        if not kept:
            return low
        last = points.index(kept[-1])
        if last == POINTS:
            return high
        low, high = points[last], points[last + 1]
    return (low + high) / 2


def exponent(sources: DataFrame, budget: int, flatten: float = 0.5, max_repeats: float | None = 4.0) -> float:
    """The exponent for a table of sources (tokens), to six places.

    The target entropy lies the share `flatten` of the way from the entropy of the sources as they are to that of equal
    weights. `max_repeats` limits budget * weight / tokens of every source; where even the shares as they are pass it, the
    exponent is 1.
    """
    total = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[1]:
        return 1.0
    shares = sources.select("tokens", (F.col("tokens") / F.lit(float(total[0]))).alias("p"))
    natural = _at(shares, [1.0], budget)[0]["entropy"]
    target = natural + flatten * (math.log(total[1]) - natural)
    found = _bisected(shares, budget, lambda r: r["entropy"] >= target - 1e-12)
    if max_repeats is not None:
        found = max(found, _bisected(shares, budget, lambda r: r["repeats"] > max_repeats + 1e-12))
    return round(found, 6)


def mixed(docs: DataFrame, by: str = "source", key: str = "doc_id", text: str = "text", budget: int | None = None, flatten: float = 0.5,
          max_repeats: float | None = 4.0, block_tokens: int = 100_000, seed: str = "42") -> DataFrame:
    """The mixture, a row per chosen copy of a document: doc_id, source, tokens, epoch, stream_at, mix_at.

    `stream_at` is the first token's place in the stream of the source, `mix_at` that place as a share of its quota: sorted
    by it, any prefix of the mixture holds the sources in about their weights. A document is taken when it begins inside the
    quota. The budget is all tokens of `docs` unless given. Null sources are one source, null text counts as empty,
    null ids hash as the empty text; rows that repeat an id follow each other by their tokens. An empty table gives an
    empty result.
    """
    lean = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(by).cast("string").alias("source"), tokens_of(text).alias("tokens")), "mix-docs")
    sources = stored(lean.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    power = exponent(sources, budget, flatten, max_repeats)
    raised = sources.withColumn("w", F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(power)))
    norm = raised.agg(F.sum("w")).first()[0] or 1.0
    quotas = raised.select(F.col("source").alias("s"), F.col("tokens").alias("size"), F.round(F.lit(float(budget)) * F.col("w") / F.lit(norm)).cast("long").alias("quota"))
    digits = F.greatest(F.lit(0), F.least(F.lit(4), F.ceil(F.log(F.col("size") / F.lit(float(block_tokens))) / F.lit(math.log(16)))))
    quotas = stored(quotas.withColumn("epochs", F.ceil(F.col("quota") / F.col("size"))).withColumn("digits", digits.cast("int")), "mix-quotas")

    def hashed(*parts) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))

    rows = lean.join(quotas, F.col("source").eqNullSafe(F.col("s"))).where("quota > 0").withColumn(
        "block", F.expr(f"substring(md5(concat_ws('|', '{seed}', coalesce(cast(doc_id as string), ''))), 1, digits)"))
    counted = rows.groupBy("s", "block", "size", "epochs").agg(F.sum("tokens").alias("held")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    order = Window.partitionBy("s", "epoch").orderBy(hashed(F.col("epoch"), F.col("block")), "block")
    begin = F.col("epoch") * F.col("size") + F.sum("held").over(order) - F.col("held")
    blocks = counted.select(F.col("s").alias("b_source"), F.col("block").alias("b_block"), F.col("epoch").alias("b_epoch"), begin.alias("begin"))
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    placed = copies.join(blocks, F.col("s").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")) & (F.col("epoch") == F.col("b_epoch"))).where(
        F.col("begin") < F.col("quota"))
    inside = Window.partitionBy("s", "epoch", "block").orderBy(hashed(F.col("epoch"), F.col("doc_id")), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("begin") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return placed.withColumn("stream_at", at).where("stream_at < quota").select(
        "doc_id", "source", "tokens", "epoch", "stream_at", (F.col("stream_at") / F.col("quota")).alias("mix_at"))


def draw(docs: DataFrame, by: str = "source", key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The documents of the mixture with all their columns, a row per chosen copy."""
    chosen = mixed(docs, by, key, text, **rules).groupBy(F.col("doc_id").alias("__id"), F.col("tokens").alias("__n"), F.col("source").alias("__source")).agg(
        F.count(F.lit(1)).alias("__taken"))
    alike = Window.partitionBy(F.col(key).cast("long"), "__words", F.col(by).cast("string"))
    counted = docs.withColumn("__words", tokens_of(text))
    same = F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__n")) & F.col(by).cast("string").eqNullSafe(F.col("__source"))
    joined = counted.join(chosen, same).withColumn("__row", F.row_number().over(alike.orderBy(text))).withColumn("__rows", F.count(F.lit(1)).over(alike))
    times = F.floor((F.col("__taken") + F.col("__rows") - F.col("__row")) / F.col("__rows")).cast("int")  # of repeated rows each gets its part
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(0), times))).where("__copy > 0").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) + 1 AS BIGINT) AS tokens FROM documents),
sizes AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS size, CAST(sum(sum(tokens)) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM docs GROUP BY source),
shares AS (SELECT source, size, total, n, CAST(size AS DOUBLE) / CAST(total AS DOUBLE) AS p FROM sizes),
goal AS (SELECT -sum(p * ln(p)) + 0.5 * (ln(max(n)) + sum(p * ln(p))) AS target FROM shares),
steps(step, low, high) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT step + 1,
           CASE WHEN entropy >= target - 1e-12 THEN middle ELSE low END, CASE WHEN entropy >= target - 1e-12 THEN high ELSE middle END
    FROM (SELECT step, low, high, (low + high) / 2 AS middle, max(target) AS target,
                 ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) AS entropy
          FROM steps, shares, goal WHERE step < 40 GROUP BY step, low, high)),
repeat_steps(step, low, high) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT step + 1, CASE WHEN repeats > 4 + 1e-12 THEN middle ELSE low END, CASE WHEN repeats > 4 + 1e-12 THEN high ELSE middle END
    FROM (SELECT step, low, high, (low + high) / 2 AS middle,
                 max(total) * max(pow(p, (low + high) / 2) / size) / sum(pow(p, (low + high) / 2)) AS repeats
          FROM repeat_steps, shares WHERE step < 40 GROUP BY step, low, high)),
power AS (SELECT round(greatest((SELECT (low + high) / 2 FROM steps WHERE step = 40), (SELECT (low + high) / 2 FROM repeat_steps WHERE step = 40)), 6) AS x),
quotas AS (
    SELECT source, size, CAST(round(total * pow(p, x) / sum(pow(p, x)) OVER ()) AS BIGINT) AS quota,
           CAST(greatest(0, least(4, ceil(ln(size / 100000.0) / ln(16)))) AS INTEGER) AS digits
    FROM shares, power),
rows AS (
    SELECT d.*, size, quota, substr(md5('42|' || doc_id), 1, digits) AS block, unnest(range(CAST(ceil(quota / size) AS BIGINT))) AS epoch
    FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
blocks AS (
    SELECT source, epoch, block, epoch * any_value(size) + sum(sum(tokens)) OVER (PARTITION BY source, epoch ORDER BY md5('42|' || epoch || '|' || block), block) - sum(tokens) AS start
    FROM rows GROUP BY source, epoch, block),
placed AS (
    SELECT r.*, CAST(start + sum(tokens) OVER (PARTITION BY r.source, r.epoch, r.block ORDER BY md5('42|' || r.epoch || '|' || doc_id), doc_id, tokens
                                          ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS stream_at
    FROM rows r JOIN blocks b ON r.source IS NOT DISTINCT FROM b.source AND r.epoch = b.epoch AND r.block = b.block)
SELECT doc_id, source, tokens, epoch, stream_at, CAST(stream_at AS DOUBLE) / quota AS mix_at FROM placed WHERE stream_at < quota
"""
