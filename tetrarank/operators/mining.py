"""Preference pair mining from scored candidate lists."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrarank.functions import numeric as nx
from tetrarank.operators.items import POOL_FLOOR, POOL_SHARE, score_pools
from tetrarank.operators.scale import by_size, checkpoint_dir, stored, top_k

LEVELS = ["easy", "medium", "hard"]
PER_LEVEL = 3
MAX_USES = 3


def needed(per_level: int, max_uses: int) -> tuple[int, int]:
    """(anchors, partners per anchor) that leave a free choice whenever the list holds one.

    All pairs of a prompt use up at most `spent` items. An anchor can also have met `max_uses` - 1 partners before.
    """
    spent = 2 * per_level * len(LEVELS) // max_uses
    return per_level + spent, spent + max_uses


def candidate_pairs(scored: DataFrame, *, by: str = "prompt_id", item_id: str = "item_id", score: str = "score", seed: str = "42",
                    per_level: int = PER_LEVEL, max_uses: int = MAX_USES) -> DataFrame:
    """Anchors and partners per prompt and level, each in md5 order and cut to what a choice can need.

    easy: top against low; medium: middle pool with a gap in (0.2, 0.5); hard: top pool with a gap under
    0.2. Pools of short lists overlap. Partners outside the gap follow those inside it, and items outside the pool
    follow those inside it, so a pool that is too small is made up from the whole list. Pools are never paired
    exhaustively: a fixed number of anchors meets the score bins that its gap can reach, and only those of them that find too
    few partners there meet the whole list.
    """
    checkpoint_dir(scored.sparkSession)
    n_anchors, n_partners = needed(per_level, max_uses)
    pools = score_pools(scored.select(by, item_id, score), by, score, item_id)
    # Anchors and partners both read the pools, so the ranking behind them is done once and stored.
    keyed = pools.select(by, F.col(item_id).alias("item"), F.col(score).alias("s"), "is_top", "is_low", "is_mid").checkpoint()
    roles = F.explode(F.array(
        F.struct(F.lit("easy").alias("level"), F.col("is_top").alias("anchors"), F.col("is_low").alias("partners")),
        F.struct(F.lit("medium").alias("level"), F.col("is_mid").alias("anchors"), F.col("is_mid").alias("partners")),
        F.struct(F.lit("hard").alias("level"), F.col("is_top").alias("anchors"), F.col("is_top").alias("partners"))))
    roled = keyed.select(by, "item", "s", roles.alias("role"))
    hashed = nx.hash_text(F.col(by), F.col("item"), F.col("role.level"), seed=seed)
    anchors = roled.select(by, F.col("role.level").alias("level"), F.col("item").alias("anchor"), F.col("s").alias("anchor_score"),
                           F.col("role.anchors").alias("own"), hashed.alias("h"))
    anchors = top_k(anchors, [by, "level"], [F.desc("own"), F.col("h"), F.col("anchor")], n_anchors, rank="anchor_no").drop("h", "own")
    partners = roled.select(by, F.col("role.level").alias("level"), F.col("item").alias("partner"), F.col("s").alias("partner_score"),
                            F.col("role.partners").alias("own"))
    anchors, partners = anchors.checkpoint(), partners.withColumn("bin", _bin(F.col("partner_score")))
    gap = F.abs(F.col("anchor_score") - F.col("partner_score"))
    in_band = (F.when(F.col("level") == "medium", (gap > 0.2) & (gap < 0.5)).when(F.col("level") == "hard", gap < 0.2).otherwise(F.lit(True)))

    def best(met: DataFrame) -> DataFrame:
        hashed_pair = nx.hash_text(F.col(by), F.col("anchor"), F.col("partner"), seed=seed)
        return top_k(met.withColumn("h", hashed_pair), [by, "level", "anchor_no"], [F.desc("in_band"), F.desc("own"), F.col("h"), F.col("partner")], n_partners,
                     rank="partner_no").drop("h", "own")

    names = [by, "level", "partner", "partner_score", "own", "anchor", "anchor_score", "anchor_no", "in_band"]
    reach = F.when(F.col("level") == "hard", F.sequence(F.lit(-2), F.lit(2))).when(
        F.col("level") == "medium", F.concat(F.sequence(F.lit(-5), F.lit(-2)), F.sequence(F.lit(2), F.lit(5)))).otherwise(F.array(F.lit(0)))
    aimed = anchors.withColumn("bin", F.explode(F.transform(reach, lambda d: d + F.when(F.col("level") == "easy", 0).otherwise(_bin(F.col("anchor_score"))))))
    pool = partners.where("own").withColumn("bin", F.when(F.col("level") == "easy", 0).otherwise(F.col("bin")))
    near = pool.join(aimed, [by, "level", "bin"]).where((F.col("anchor") != F.col("partner")) & in_band).withColumn("in_band", F.lit(True)).select(*names)
    near = best(near).checkpoint()
    found = near.groupBy(by, "level", "anchor_no").agg(F.count(F.lit(1)).alias("n"))
    short = anchors.join(found, [by, "level", "anchor_no"], "left").where(F.coalesce("n", F.lit(0)) < n_partners).drop("n")
    every = (partners.drop("bin").join(short, [by, "level"]).where(F.col("anchor") != F.col("partner"))
             .withColumn("in_band", F.col("own") & in_band).select(*names))
    enough = near.join(short.select(by, "level", "anchor_no"), [by, "level", "anchor_no"], "left_anti")
    return enough.unionByName(best(every))


def _bin(score: Column) -> Column:
    """Score bins of a tenth: partners with a gap under 0.2 lie at most two away, those with a gap in (0.2, 0.5) two to five."""
    return F.floor(score * 10.0).cast("int")


def _choose(rows: pd.DataFrame, by: str, per_level: int, max_uses: int) -> pd.DataFrame:
    """Walk anchors and partners in order; an item is used at most `max_uses` times, a pair once."""
    uses: dict = {}
    taken: set = set()
    out = []
    for level in LEVELS:
        made = 0
        of_level = rows[rows["level"] == level].sort_values(["anchor_no", "partner_no"])
        for _, options in of_level.groupby("anchor_no", sort=True):
            if made == per_level:
                break
            for r in options.itertuples(index=False):
                pair = frozenset((r.anchor, r.partner))
                if uses.get(r.anchor, 0) < max_uses and uses.get(r.partner, 0) < max_uses and pair not in taken:
                    made += 1
                    taken.add(pair)
                    uses[r.anchor] = uses.get(r.anchor, 0) + 1
                    uses[r.partner] = uses.get(r.partner, 0) + 1
                    out.append((getattr(r, by), level, made, r.anchor, r.partner, r.anchor_score, r.partner_score))
                    break
    return pd.DataFrame(out, columns=[by, "difficulty", "pair_no", "movieA", "movieB", "score_a", "score_b"])


#: Items of a list that is mined in one task; the pools of longer lists are ranked and met as tables.
LIST_ROWS = 10_000


def _easier(own: list[bool], digest: Callable[[int], bytes], k: int, places: range, grade: Callable[[int], tuple]) -> list[int]:
    """The first k places by grade, then hash; hashes are made only where they decide."""
    best = [i for i in places if own[i]]
    rest = best if len(best) >= k else places
    return heapq.nsmallest(k, rest, key=lambda i: (grade(i), digest(i), i))


def _pairs_of_list(prompt: str, items: list, texts: list, scores: list, seed: str, per_level: int, max_uses: int) -> list[tuple]:
    """Pairs of one list, given best item first: the choice of `_choose` from the options of `candidate_pairs`."""
    n_anchors, n_partners = needed(per_level, max_uses)
    n = len(items)
    size = max(POOL_FLOOR, n // POOL_SHARE)
    top, low = [i < size for i in range(n)], [i >= n - size for i in range(n)]
    mid = [not t and not w for t, w in zip(top, low)]
    uses: dict = {}
    taken: set = set()
    out = []

    def digest(*parts) -> bytes:
        return md5("|".join([seed, prompt, *[p for p in parts if p is not None]]).encode()).digest()

    for level, anchors, partners in (("easy", top, low), ("medium", mid, mid), ("hard", top, top)):
        made = 0
        for a in _easier(anchors, lambda i: digest(texts[i], level), n_anchors, range(n), lambda i: (not anchors[i],)):
            if made == per_level:
                break
            if items[a] is None or uses.get(items[a], 0) >= max_uses:
                continue

            def band(i: int) -> bool | None:
                if not partners[i]:
                    return False
                if level == "easy":
                    return True
                if scores[a] is None or scores[i] is None:
                    return None
                gap = abs(scores[a] - scores[i])
                return 0.2 < gap < 0.5 if level == "medium" else gap < 0.2

            others = [i for i in range(n) if items[i] is not None and items[i] != items[a]]
            inside = {i: band(i) for i in others}
            ranked = _easier([inside.get(i, False) is True for i in range(n)], lambda i: digest(texts[a], texts[i]), n_partners, others,
                             lambda i: (2 if inside[i] is None else 1 - inside[i], not partners[i]))
            for p in ranked:
                pair = frozenset((items[a], items[p]))
                if uses.get(items[p], 0) < max_uses and pair not in taken:
                    made += 1
                    taken.add(pair)
                    uses[items[a]] = uses.get(items[a], 0) + 1
                    uses[items[p]] = uses.get(items[p], 0) + 1
                    out.append((level, made, items[a], items[p], *[None if x != x else x for x in (scores[a], scores[p])]))  # NaN as null
                    break
    return out


def _mine_lists(seed: str, per_level: int, max_uses: int, target: pa.Schema) -> Callable:
    """Rows (prompt, its text, item, its text, score) that lie by prompt, best score first, to the pairs of each prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]  # the list that may go on in the next batch

        def mined(rows: list[list], starts: list[int], stop: int) -> pa.RecordBatch:
            out = []
            for at, end in zip(starts, [*starts[1:], stop]):
                for pair in _pairs_of_list(rows[1][at], rows[2][at:end], rows[3][at:end], rows[4][at:end], seed, per_level, max_uses):
                    out.append((rows[0][at], *pair))
            columns = list(zip(*out)) if out else [[] for _ in target]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            rows = [h + c.to_pylist() for h, c in zip(held, batch.columns)]
            keys = rows[1]
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            if not starts:
                continue
            yield mined(rows, starts[:-1], starts[-1])
            held = [c[starts[-1]:] for c in rows]
        if held[1]:
            yield mined(held, [0], len(held[1]))

    return run


def _mined_short(scored: DataFrame, by: str, item_id: str, score: str, seed: str, per_level: int, max_uses: int, schema: T.StructType) -> DataFrame:
    """Pairs of lists that each fit a task: one shuffle by prompt, sorted there."""
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = scored.where(F.col(by).isNotNull()).select(F.col(by).alias("key"), F.col(by).cast("string").alias("prompt"), F.col(item_id).alias("item"),
                                                      F.col(item_id).cast("string").alias("text"), F.col(score).cast("double").alias("s"))
    placed = rows.repartition("key").sortWithinPartitions("key", F.desc_nulls_last("s"), F.asc_nulls_first("item"))
    return placed.mapInArrow(_mine_lists(seed, per_level, max_uses, to_arrow_schema(schema)), schema)


def mine_pairs(scored: DataFrame, *, by: str = "prompt_id", item_id: str = "item_id", score: str = "score",
               seed: str = "42", per_level: int = PER_LEVEL, max_uses: int = MAX_USES) -> DataFrame:
    """Judged pairs of each prompt, up to `per_level` easy, medium and hard ones.

    Lists of at most LIST_ROWS items are mined where they lie, longer ones from tables of their anchors and partners.
    """
    by_type, item_type = scored.schema[by].dataType, scored.schema[item_id].dataType
    schema = T.StructType([T.StructField(by, by_type), T.StructField("difficulty", T.StringType()), T.StructField("pair_no", T.LongType()),
                           T.StructField("movieA", item_type), T.StructField("movieB", item_type), T.StructField("score_a", T.DoubleType()),
                           T.StructField("score_b", T.DoubleType())])
    short, large = by_size(stored(scored.select(by, item_id, score), "lists"), [by], LIST_ROWS)
    chosen = _mined_short(short, by, item_id, score, seed, per_level, max_uses, schema)
    if large is not None:
        candidates = candidate_pairs(large, by=by, item_id=item_id, score=score, seed=seed, per_level=per_level, max_uses=max_uses)
        chosen = chosen.unionByName(candidates.groupBy(by).applyInPandas(lambda rows: _choose(rows, by, per_level, max_uses), schema))
    gap = F.col("score_a") - F.col("score_b")
    return chosen.select(
        by, F.concat_ws("_", by, "difficulty", "pair_no").alias("pair_id"), "difficulty", "movieA", "movieB",
        "score_a", "score_b", F.when(gap >= 0, 1).otherwise(-1).alias("m1_gt_m2"),
        F.when(gap >= 0, -1).otherwise(1).alias("m2_gt_m1"),
        nx.pair_confidence(gap, F.col("difficulty")).alias("confidence"))
