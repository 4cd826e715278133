"""Exact nearest neighbours over a kept index of cells: cells that cannot hold a hit are not read.

Items are clustered once; a cell knows its centre and its radius, the largest distance of an item from the centre. By the triangle
inequality no item of a cell is nearer to a query than |q - c| - r, and for a query of length one no inner product is above
q c + r. A search scores the most promising cells of every query first. What its k-th best item has there is a threshold, and
of the other cells only those whose bound reaches it are read. The clusters decide how much is skipped, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrarank.functions import vectors as vx
from tetrarank.functions.numeric import hash_uniform
from tetrarank.operators.blocks import DECIMALS, Running, _arrow, list_matrix
from tetrarank.operators.dense import _Vectors
from tetrarank.operators.scale import checkpoint_dir, shared_path, top_k

#: Centres are broadcast: at most MOST_CELLS rows of one vector each. They are fitted on about SAMPLE items; all items are indexed.
MOST_CELLS, SAMPLE = 2048, 100_000
#: Rows of one task: items of a part of a cell, queries of a block.
PART_ROWS = 20_000
#: Items of a group of cells, to which a query goes once; queries and items of a block, whose scores are one matrix.
GROUP_ITEMS, QUERY_ROWS, ITEM_ROWS = 100_000, 2_000, 2_000
SLACK = 2.0 * 10.0 ** -DECIMALS


@dataclass(frozen=True)
class CellIndex:
    """items(item_id, vector, cell, part), cells(cell, centre, radius, size, parts)."""

    items: DataFrame
    cells: DataFrame
    metric: str

    @staticmethod
    def read(spark: SparkSession, path: str, metric: str) -> CellIndex:
        return CellIndex(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/cells"), metric)


def build_cells(items: DataFrame, metric: str = "cosine", *, item_id: str = "item_id", vector: str = "vector", cells: int | None = None,
                part_rows: int = PART_ROWS, path: str | None = None, seed: int = 42) -> CellIndex:
    """Index items for one metric ("ip", "cosine", "l2") at a path, or in the shared folder. Rows without a vector are left out.

    By default there are about sqrt(n) cells, at most MOST_CELLS. A cell of any size is cut into parts of about `part_rows` rows.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = items.sparkSession
    path = path or shared_path(spark, f"cells-{metric}")
    rows = items.select(F.col(item_id).alias("item_id"), vx.as_double(F.col(vector)).alias("vector")).where("vector is not null")
    n = rows.count()
    placed = vx.l2_normalize(F.col("vector")) if metric == "cosine" else F.col("vector")
    points = rows.withColumn("point", placed)
    k = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
    if n:
        share = min(1.0, max(SAMPLE, 50 * k) / n)
        sample = points.where(hash_uniform(F.col("item_id"), seed="cells") < share) if share < 1.0 else points
        model = KMeans(k=k, maxIter=5, initMode="random", seed=seed, featuresCol="features", predictionCol="cell").fit(sample.select(array_to_vector("point").alias("features")))
        centres = [c.tolist() for c in model.clusterCenters()]
        placed_rows = model.transform(points.withColumn("features", array_to_vector("point"))).drop("features")
    else:
        centres, placed_rows = [], points.withColumn("cell", F.lit(0))
    table = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sized = placed_rows.join(F.broadcast(table), "cell")
    distance = F.sqrt(vx.squared_l2(F.col("point"), F.col("centre")))
    known = sized.groupBy("cell").agg(F.max(distance * (1.0 + 1e-9) + 1e-12).alias("radius"), F.count(F.lit(1)).alias("size"))
    known = table.join(known, "cell").withColumn("parts", F.ceil(F.col("size") / F.lit(float(part_rows))).cast("int"))
    known.coalesce(1).write.parquet(f"{path}/cells")  # at most MOST_CELLS rows
    known = spark.read.parquet(f"{path}/cells")
    parted = placed_rows.join(F.broadcast(known.select("cell", "parts")), "cell").select(
        "item_id", "vector", "cell", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int").alias("part"))
    parted.repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/items")
    return CellIndex.read(spark, path, metric)


def _groups(cells: pa.Table) -> pa.Table:
    """(cell, part, group): parts of cells put together, in their order, to groups of about GROUP_ITEMS items. A row per part."""
    parts = cells.column("parts").to_numpy().astype(np.int64)
    cell = np.repeat(cells.column("cell").to_numpy(), parts)
    rows = np.repeat(cells.column("size").to_numpy() / parts, parts)
    return pa.table({"cell": pa.array(cell, pa.int32()), "part": pa.array(np.concatenate([np.arange(n) for n in parts]), pa.int32()),
                     "g": pa.array(((np.cumsum(rows) - rows) // GROUP_ITEMS).astype(np.int32))})


def _visits(cells: pa.Table, groups: pa.Table, metric: str, k: int, fields: pa.Schema, first: bool) -> Callable:
    """Queries to the groups of cells they visit, a row per query and group with the cells: with `first` the best ones until they hold
    k items, otherwise all others whose bound reaches `least`."""
    centre, radius = list_matrix(cells.column("centre")), cells.column("radius").to_numpy()
    number, size = cells.column("cell").to_numpy(), cells.column("size").to_numpy()
    pairs = groups.group_by(["g", "cell"]).aggregate([])
    place = np.argsort(number)[np.searchsorted(np.sort(number), pairs.column("cell").to_numpy())]
    members = {g: np.sort(place[pairs.column("g").to_numpy() == g]) for g in np.unique(pairs.column("g").to_numpy())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                q = list_matrix(batch.column(1))
                if metric == "l2":
                    apart = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centre * centre).sum(1)[None] - 2.0 * (q @ centre.T), 0.0))
                    bound = -np.maximum(apart - 1e-6 - radius, 0.0) ** 2
                else:
                    bound = (q / (np.linalg.norm(q, axis=1, keepdims=True) + vx.EPS)) @ centre.T + radius
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1) - size[order]
                seed = np.zeros(bound.shape, bool)
                np.put_along_axis(seed, order, held < k, axis=1)
                chosen = seed
                if not first:
                    least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)  # null (fewer than k hits) is NaN
                    chosen = ~seed & ~(bound < least[:, None] - SLACK)
                for g, own in members.items():
                    row, cell = np.nonzero(chosen[:, own])
                    if len(row):
                        some, count = np.unique(row, return_counts=True)
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(number[own[cell]], pa.int32()))
                        taken = batch.take(pa.array(some))
                        known = pa.nulls(len(some), pa.float64()) if first else taken.column(2)
                        columns = [taken.column(0), taken.column(1), known, pa.array(np.full(len(some), g), pa.int32()), lists]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return run


def search(index: CellIndex, queries: DataFrame, k: int, *, query_id: str = "query_id", vector: str = "vector", query_rows: int = PART_ROWS,
           report: dict | None = None) -> DataFrame:
    """k best items per query: query_id, item_id, score, the same rows as `dense.search`.

    `report` receives how many (query, cell) pairs there are and how many were read.
    """
    spark = queries.sparkSession
    checkpoint_dir(spark)
    asked = queries.select(F.col(query_id).alias("query_id"), vx.as_double(F.col(vector)).alias("vector")).where("vector is not null")
    cells = index.cells.toArrow()  # at most MOST_CELLS rows
    id_type, item_type = asked.schema["query_id"].dataType, index.items.schema["item_id"].dataType
    result = T.StructType([T.StructField("query_id", id_type), T.StructField("item_id", item_type), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([("query_id", _arrow(id_type)), ("item_id", _arrow(item_type)), ("score", pa.float64())])
    if not cells.num_rows:
        return spark.createDataFrame([], result)
    fields = pa.schema([("query_id", _arrow(id_type)), ("vector", pa.list_(pa.float64())), ("least", pa.float64()), ("g", pa.int32()), ("cells", pa.list_(pa.int32()))])
    visit_schema = f"query_id {id_type.simpleString()}, vector array<double>, least double, g int, cells array<int>"
    blocks = max(1, -(-asked.count() // query_rows))
    groups, scorer = _groups(cells), _Vectors(index.metric)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of queries and a group of cells: every query meets the cells it visits."""
        right = right.sort_by("cell") if right.num_rows else right
        numbers, found = right.column("cell").to_numpy(), []
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])[:len(numbers)])
        spans = [(at, min(at + ITEM_ROWS, to)) for a, to in zip(starts, np.append(starts[1:], len(numbers)), strict=True) for at in range(a, to, ITEM_ROWS)]
        pieces = [(numbers[a], scorer.right(right.slice(a, to - a)), right.column("item_id").slice(a, to - a).to_numpy()) for a, to in spans]
        for s in range(0, left.num_rows if spans else 0, QUERY_ROWS):
            part = left.slice(s, QUERY_ROWS)
            lists = part.column("cells").combine_chunks()
            row, asked_cell = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            by_cell = np.argsort(asked_cell, kind="stable")
            row, asked_cell = row[by_cell], asked_cell[by_cell]
            queries, run = scorer.left(part), Running(part.num_rows, k, part.column("least").to_numpy(zero_copy_only=False).astype(float))
            for cell, piece, ids in pieces:
                rows = row[np.searchsorted(asked_cell, cell):np.searchsorted(asked_cell, cell, side="right")]
                if len(rows):
                    run.add(scorer, tuple(x[rows] for x in queries), piece, ids, rows)
            hits = run.merged()
            if hits is not None:
                found.append(pa.table([part.column("query_id").take(pa.array(hits[0])), pa.array(hits[2]), pa.array(hits[1])], names=arrow.names).cast(arrow))
        return pa.concat_tables(found) if found else arrow.empty_table()

    def read(visits: DataFrame) -> DataFrame:
        going = visits.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        items = index.items.join(F.broadcast(spark.createDataFrame(groups)), ["cell", "part"]).select("item_id", "vector", "cell", "g")
        if blocks == 1:
            items = items.withColumn("b", F.lit(0).cast("bigint"))
        else:
            items = items.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        return going.groupBy("g", "b").cogroup(items.groupBy("g", "b")).applyInArrow(score, result)

    order = [F.desc("score"), F.col("item_id")]
    seeds = asked.mapInArrow(_visits(cells, groups, index.metric, k, fields, True), visit_schema)
    first = top_k(read(seeds), ["query_id"], order, k).checkpoint()
    least = first.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") == k).select(
        F.col("query_id").alias("__q"), F.col("score").alias("least"))
    bounded = asked.join(least, F.col("query_id").eqNullSafe(F.col("__q")), "left").select("query_id", "vector", "least")
    rest = bounded.mapInArrow(_visits(cells, groups, index.metric, k, fields, False), visit_schema)
    if report is not None:
        once = F.broadcast(spark.createDataFrame(groups).groupBy("cell").agg(F.min("g").alias("g")))  # parts of a cell may lie in several groups
        report.update(pairs=asked.count() * cells.num_rows,
                      read=sum(x.select("g", F.explode("cells").alias("cell")).join(once, ["cell", "g"]).count() for x in (seeds, rest)))
    hits = top_k(first.unionByName(read(rest)), ["query_id"], order, k)
    return hits.withColumn("score", F.abs("score")) if index.metric == "l2" else hits
