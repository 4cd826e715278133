"""The best items per prompt by proxy score, over a kept inverted index of genres and title words.

Items with the same genres form a cell (cut into parts of bounded size): genre match and history are the same for all of them. A
cell also knows the smallest and largest value of each emotion, and an inverted list leads from each title word to the cells that
have it. So per prompt and cell there is a bound: the exact genre parts, the emotion product at its best, and for the
title words at most the share of the prompt's words that the cell has at all. The most promising cells of a prompt are scored first;
after that only those whose bound reaches its k-th best score are read.

Cells are put together to groups. A prompt goes once to each group with a cell that could reach that score if it had all the words, and the
inverted lists go there, too: bounds with words are made where the items lie, so no (prompt, cell) pair is ever a row. Groups
and blocks of prompts are of bounded size: more prompts or items make more tasks, not larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrarank.constants import EXPERTS
from tetrarank.operators.blocks import BROADCAST_BYTES, DECIMALS, ITEM_ROWS, QUERY_ROWS, Running, _arrow, list_matrix
from tetrarank.operators.embed import _matrix, _proxy_matrix
from tetrarank.operators.runs import firsts
from tetrarank.operators.scale import checkpoint_dir, shared_path, stored, top_k

PART_ROWS = 2_000
#: Items and cells of a group, and prompts of a block: a group meets a block in one task.
GROUP_ITEMS, GROUP_CELLS, BLOCK_PROMPTS = 100_000, 2_000, 100_000
#: Rows that a task sends to groups and blocks, about.
SENT_ROWS = 300_000
#: Bounds (prompts times cells) that a task holds at once, and words that are looked up at once.
BOUNDS, WORDS = 4_000_000, 4_096
SETS = ["target_genres", "negative_genres", "prompt_tokens", "liked_genres", "disliked_genres"]
COLUMNS = [*SETS, "prompt_emo", *[f"w_{e}" for e in EXPERTS]]
SLACK = 2.0 * 10.0 ** -DECIMALS


@dataclass(frozen=True)
class ProxyIndex:
    """items(item_id, genres, title_tokens, item_emo, cell), cells(cell, genres, low, high, size), words(word, cells)."""

    items: DataFrame
    cells: DataFrame
    words: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> ProxyIndex:
        return ProxyIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("items", "cells", "words")])


def build_index(items: DataFrame, *, item_id: str = "item_id", part_rows: int = PART_ROWS, path: str | None = None) -> ProxyIndex:
    """Index (item_id, genres, title_tokens, item_emo) at a path, or in the shared folder. Null lists are empty; emotions are of one length."""
    spark = items.sparkSession
    path = path or shared_path(spark, "proxy")
    empty = F.array().cast("array<string>")
    rows = items.select(F.col(item_id).alias("item_id"), *[F.coalesce(c, empty).alias(c) for c in ("genres", "title_tokens")], "item_emo")
    keyed = rows.withColumn("key", F.to_json(F.array_sort(F.array_distinct("genres"))))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(part_rows))).alias("parts")).withColumnRenamed("key", "k")
    part = F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("string")
    placed = keyed.join(sizes, F.col("key") == F.col("k")).select("item_id", "genres", "title_tokens", "item_emo", F.concat_ws("#", part, "key").alias("cell"))
    placed.repartition("cell").sortWithinPartitions("cell").write.parquet(f"{path}/items")
    placed = spark.read.parquet(f"{path}/items")
    n = placed.agg(F.max(F.size("item_emo"))).first()[0] or 0
    cells = placed.groupBy("cell").agg(
        F.first("genres").alias("genres"), F.array(*[F.min(F.col("item_emo")[i]) for i in range(n)]).cast("array<double>").alias("low"),
        F.array(*[F.max(F.col("item_emo")[i]) for i in range(n)]).cast("array<double>").alias("high"), F.count(F.lit(1)).alias("size"))
    cells.write.parquet(f"{path}/cells")
    placed.select(F.explode("title_tokens").alias("word"), "cell").distinct().write.parquet(f"{path}/words")
    return ProxyIndex.read(spark, path)


def _groups(cells: pa.Table, items: int) -> np.ndarray:
    """Group of each cell. Cells in the order of their genres fill groups of about `items` items and at most GROUP_CELLS cells."""
    size = cells.column("size").to_numpy()
    order = np.array(sorted(range(len(size)), key=[c.partition("#")[::-1] for c in cells.column("cell").to_pylist()].__getitem__), np.int64)
    out, g, held, count = np.empty(len(size), np.int32), 0, 0, 0
    for c in order:
        if held >= items or count == GROUP_CELLS:
            g, held, count = g + 1, 0, 0
        out[c], held, count = g, held + int(size[c]), count + 1
    return out


class _Cells:
    """What tasks need of the cells: sizes, groups, and bounds without the title words."""

    def __init__(self, cells: pa.Table, group: np.ndarray):
        self.size, self.group, self.genres = cells.column("size").to_numpy(), group, cells.column("genres").combine_chunks()
        self.low, self.high = list_matrix(cells.column("low")), list_matrix(cells.column("high"))

    def bounds(self, prompts: pa.Table, at: np.ndarray) -> np.ndarray:
        low, high = self.low[at], self.high[at]
        flat = pa.table({"genres": self.genres.take(pa.array(at)), "title_tokens": pa.array([[]] * len(at), pa.list_(pa.string())),
                         "item_emo": pa.array(np.zeros(low.shape).tolist(), pa.list_(pa.float64()))})
        emo, weight = list_matrix(prompts.column("prompt_emo")), prompts.column("w_delta").to_numpy()[:, None]
        least_emo = np.minimum(emo, 0) @ high.T + np.maximum(emo, 0) @ low.T
        most_emo = np.maximum(emo, 0) @ high.T + np.minimum(emo, 0) @ low.T
        return _proxy_matrix(prompts, flat) + np.maximum(weight * most_emo, weight * least_emo)


def _word_weight(prompts: pa.Table) -> np.ndarray:
    return np.maximum(prompts.column("w_beta").to_numpy(), 0.0)


def _reach(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    return ~(bound < least - SLACK)  # no least (fewer than k hits) is NaN


def _visits(cells: _Cells, k: int, fields: pa.Schema, first: bool) -> Callable:
    """Prompts with `least` to the groups they visit, a row per prompt and group: with `first` those of the best cells (listed) until these
    hold k items, otherwise all groups with a cell in reach."""
    every = np.arange(len(cells.size))
    members = [np.flatnonzero(cells.group == g) for g in range(int(cells.group.max()) + 1)]
    step = max(1, min(1000, BOUNDS // len(every)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                prompts = pa.Table.from_batches([batch])
                bound = cells.bounds(prompts, every)
                if first:
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(cells.size[order], axis=1) - cells.size[order]
                    chosen = np.zeros(bound.shape, bool)
                    np.put_along_axis(chosen, order, held < k, axis=1)
                else:
                    chosen = _reach(bound + _word_weight(prompts)[:, None], prompts.column("least").to_numpy().astype(float)[:, None])
                for g, own in enumerate(members):
                    row, cell = np.nonzero(chosen[:, own])
                    if not len(row):
                        continue
                    some, count = np.unique(row, return_counts=True)
                    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(own[cell], pa.int32())) if first else pa.nulls(len(some), pa.list_(pa.int32()))
                    taken = batch.take(pa.array(some))
                    known = [taken.column(taken.schema.get_field_index(f.name)).cast(f.type) for f in list(fields)[:-2]]
                    yield pa.RecordBatch.from_arrays([*known, pa.array(np.full(len(some), g, np.int32)), listed], schema=fields)

    return run


def _wanted(cells: _Cells, own: np.ndarray, prompts: pa.Table, left: dict, lists: pa.Table) -> np.ndarray:
    """Bounds of prompts and the cells `own` of a group, with the words that the inverted lists (at, word) have."""
    met = np.zeros((prompts.num_rows, len(own)))
    words, place = lists.column("word").combine_chunks(), np.searchsorted(own, lists.column("at").to_numpy())
    vocabulary = left["words"]["prompt_tokens"]
    for start in range(0, len(vocabulary) if len(words) else 0, WORDS):
        some = vocabulary.slice(start, WORDS)
        met += _matrix(*left["codes"]["prompt_tokens"], some, left["n"]) @ _matrix(words, place, some, len(own)).T
    asked = np.maximum(np.array([len(set(x or [])) for x in prompts.column("prompt_tokens").to_pylist()]), 1)
    return cells.bounds(prompts, own) + _word_weight(prompts)[:, None] * met / asked[:, None]


def _met(cells: _Cells, k: int, first: bool, asked: pa.Table, rows: pa.Table) -> tuple[list, int]:
    """A block of prompts and a group of cells (rows of items, and of inverted lists): (prompt rows, scores, items) of the hits, and how many pairs were scored."""
    listed = pc.is_valid(rows.column("word"))
    lists, items = rows.filter(listed).select(["at", "word"]), rows.filter(pc.invert(listed)).drop_columns(["word"])
    if not asked.num_rows or not items.num_rows:
        return [], 0
    items = items.sort_by("at")
    number = items.column("at").to_numpy()
    start = firsts(number)
    own, end = number[start], np.append(start[1:], len(number))
    ready: dict[int, tuple] = {}

    def piece(at: int, to: int) -> tuple:
        if at not in ready:
            some = items.slice(at, to - at)
            ready[at] = _proxy_matrix.right(some), some.column("item_id").to_numpy()
        return ready[at]

    found, scored = [], 0
    step = max(1, min(QUERY_ROWS, BOUNDS // len(own)))
    for s in range(0, asked.num_rows, step):
        part = asked.slice(s, step)
        left = _proxy_matrix.left(part)
        run = Running(part.num_rows, k, None if first else part.column("least").to_numpy().astype(float))
        if first:
            seeds = part.column("cells").combine_chunks()
            wanted = np.zeros((part.num_rows, len(own)), bool)
            wanted[np.repeat(np.arange(part.num_rows), seeds.value_lengths().to_numpy()), np.searchsorted(own, seeds.flatten().to_numpy())] = True
            order = np.flatnonzero(wanted.any(axis=0))
        else:
            bound = _wanted(cells, own, part, left, lists)
            order = np.argsort(-bound.max(axis=0), kind="stable")
            order = order[_reach(bound[:, order], run.edge[:, None]).any(axis=0)]
        for c in order:
            for at in range(start[c], end[c], ITEM_ROWS):
                q = np.flatnonzero(wanted[:, c] if first else _reach(bound[:, c], run.edge))
                if len(q):
                    right, ids = piece(at, min(at + ITEM_ROWS, end[c]))
                    run.add(_proxy_matrix, left if len(q) == part.num_rows else _proxy_matrix.some(left, q), right, ids, q)
                    scored += len(q) * len(ids)
        hits = run.merged()
        if hits is not None:
            found.append((hits[0] + s, hits[1], hits[2]))
    return found, scored


def search(index: ProxyIndex, prompts: DataFrame, k: int, *, prompt_id: str = "prompt_id", item_id: str = "item_id", report: dict | None = None) -> DataFrame:
    """k best items per prompt: prompt_id, item_id, combined, the same rows as `embed.proxy_top_items`.

    `report` receives how many (prompt, item) pairs there are and how many were scored for the result (those of the best cells, which were
    scored before for the least score, among them). An index whose cells take over
    BROADCAST_BYTES (some ten million of them) is refused: build it with larger parts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = prompts.sparkSession
    checkpoint_dir(spark)
    asked = prompts.select(F.col(prompt_id).alias("prompt_id"), *COLUMNS, F.monotonically_increasing_id().alias("n")).checkpoint()
    cells = index.cells.toArrow()
    if cells.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{cells.num_rows} cells of {cells.nbytes} bytes: build the index with larger parts")
    id_type, item_type = asked.schema["prompt_id"].dataType, index.items.schema["item_id"].dataType
    result = T.StructType([T.StructField(prompt_id, id_type), T.StructField(item_id, item_type), T.StructField("combined", T.DoubleType())])
    arrow = pa.schema([(prompt_id, _arrow(id_type)), (item_id, _arrow(item_type)), ("combined", pa.float64())])
    if not cells.num_rows:
        return spark.createDataFrame([], result)
    cores, count, total = spark.sparkContext.defaultParallelism, asked.count(), int(cells.column("size").to_numpy().sum())
    group = _groups(cells, max(1, min(GROUP_ITEMS, total // (2 * cores))))
    groups, known = int(group.max()) + 1, _Cells(cells, group)
    visit = T.StructType([*asked.schema.fields, T.StructField("least", T.DoubleType()), T.StructField("g", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    order = [F.desc("combined"), F.col(item_id)]

    def visits(rows: DataFrame, first: bool) -> DataFrame:
        sent = rows.repartition(max(cores, math.ceil(count * (1 if first else groups) / SENT_ROWS)), "n")
        return sent.mapInArrow(_visits(known, k, to_arrow_schema(visit), first), visit)

    def meet(going: DataFrame, parts: np.ndarray, first: bool, fn: Callable, schema) -> DataFrame:
        """Every group with each of its blocks of prompts (`parts` of them)."""
        tasks = 2 * int(parts.sum())
        blocks = F.broadcast(spark.createDataFrame(pa.table({"g": pa.array(np.arange(groups, dtype=np.int32)), "parts": pa.array(parts.astype(np.int64))})))
        place = F.broadcast(spark.createDataFrame(pa.table({"cell": cells.column("cell"), "g": pa.array(group), "at": pa.array(np.arange(len(group), dtype=np.int32)), "parts": pa.array(parts[group].astype(np.int64))})))
        rows = index.items.select("cell", "item_id", "genres", "title_tokens", "item_emo", F.lit(None).cast("string").alias("word"))
        if not first:
            own = asked.select(F.explode("prompt_tokens").alias("word")).distinct()
            rows = rows.unionByName(index.words.join(own, "word", "left_semi"), allowMissingColumns=True)
        if parts.max() > 1:
            rows = rows.repartition(max(cores, math.ceil(total * int(parts.max()) / SENT_ROWS)), "cell", "item_id", "word")
        rows = rows.join(place, "cell").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("b"), "at", "item_id", "genres", "title_tokens", "item_emo", "word")
        going = going.join(blocks, "g").withColumn("b", F.pmod("n", "parts")).drop("parts", "n")
        going, rows = (x.repartition(tasks, "g", "b").groupBy("g", "b") for x in (going, rows))
        return going.cogroup(rows).applyInArrow(lambda left, right: fn(left, *_met(known, k, first, left, right)), schema)

    def hits(left: pa.Table, found: list, _) -> pa.Table:
        if not found:
            return arrow.empty_table()
        q, s, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([left.column("prompt_id").take(pa.array(q)), pa.array(ids), pa.array(s)], names=arrow.names).cast(arrow)

    seeds = stored(visits(asked.withColumn("least", F.lit(None).cast("double")), True), "seeds")
    parts = np.ones(groups, np.int64)
    for g, n in seeds.groupBy("g").count().collect():  # a row per group
        parts[g] = math.ceil(n / BLOCK_PROMPTS)
    least = top_k(meet(seeds, parts, True, hits, result), [prompt_id], order, k, rank="r").where(F.col("r") == k).select(
        F.col(prompt_id).alias("__p"), F.col("combined").alias("least"))
    bounded = asked.join(least, F.col("prompt_id").eqNullSafe(F.col("__p")), "left").drop("__p").checkpoint()
    rest, parts = visits(bounded, False), np.full(groups, max(1, math.ceil(count / BLOCK_PROMPTS)))
    if report is not None:
        scored = meet(rest, parts, False, lambda _, found, n: pa.table({"n": pa.array([n], pa.int64())}), "n long").agg(F.sum("n")).first()[0]
        report.update(pairs=count * total, scored=scored or 0)
    return top_k(meet(rest, parts, False, hits, result), [prompt_id], order, k)
