"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import drop_stored, stored

LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
BATCH = 500_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) links that connect the same nodes; the root is the smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in zip(at[:len(u)].tolist(), at[len(u):].tolist(), strict=True):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    for a in range(len(root)):  # a root is smaller than its nodes, so it is settled before them
        root[a] = root[root[a]]
    top = np.array(root, np.int64)
    own = np.flatnonzero(top != np.arange(len(top)))
    return nodes[own], nodes[top[own]]


def _contract(batches):
    """Links of a task replaced by fewer that connect the same nodes, a bounded number at a time."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        u, v = _forest(*np.concatenate(held, axis=1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=LINKS)

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64))
        size += batch.num_rows
        if size >= BATCH:
            yield flush()
            size = 0
    if held:
        yield flush()


def _is_star(edges: DataFrame) -> bool:
    """Whether no node hangs on two others or on one that itself hangs."""
    ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("w"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    seen = ends.groupBy("w").agg(F.sum("hangs").alias("a"), F.max("holds").alias("b"))
    return not seen.where("a > 1 or (a > 0 and b > 0)").limit(1).count()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that has a link to another one; root is the smallest node of the component.

    Each task first replaces its own links by a forest. Then large-star hangs every larger neighbour of a node on the
    smallest node around it, and small-star does so for the smaller ones; both keep what is connected. A round
    takes minima by partial aggregation, so no neighbourhood is ever gathered, and is stored, the one before it deleted.
    It ends when every node hangs on its root.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    edges = stored(pairs.mapInArrow(_contract, "u bigint, v bigint").distinct(), "links")
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(around, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(below.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(hung.unionByName(below.select("u", F.col("m").alias("v"))).mapInArrow(_contract, "u bigint, v bigint").distinct(), "stars")
        drop_stored(spark, edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
