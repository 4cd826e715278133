"""Exact search over cells: the rows of the flat search, cells that are not read, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.operators import cells, dense


def clouds(spark, n=600, dim=12, clouds_=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clouds_, dim)) * 4
    x = centres[np.arange(n) % clouds_] + rng.normal(size=(n, dim)) * 0.3
    x[5] = x[17]  # a tie
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * dim)], "item_id long, vector array<double>")


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize(("k", "part_rows", "query_rows"), [(3, 20, 10), (40, 20_000, 20_000), (700, 100, 30)])
def test_same_rows_as_the_flat_search(spark, tmp_path, metric, k, part_rows, query_rows):
    items = clouds(spark)
    asked = items.where("item_id % 13 = 0 or item_id >= 9000").withColumnRenamed("item_id", "query_id")
    cells.build_cells(items, metric, cells=12, part_rows=part_rows, path=f"file://{tmp_path}/index")
    index = cells.CellIndex.read(spark, f"file://{tmp_path}/index", metric)  # kept
    report = {}
    got = {(r.query_id, r.item_id): r.score for r in cells.search(index, asked, k, query_rows=query_rows, report=report).collect()}
    want = {(r.query_id, r.item_id): r.score for r in dense.search(asked, items, k, metric=metric).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 2e-6 for x in got)
    assert report["pairs"] == 12 * asked.where("vector is not null").count()
    if k == 3 and metric == "l2":
        assert report["read"] <= 0.3 * report["pairs"]  # most cells are too far away
    if k == 700:
        assert report["read"] == report["pairs"]


def test_no_items_and_no_queries(spark):
    items = clouds(spark, 50)
    asked = items.withColumnRenamed("item_id", "query_id")
    assert cells.search(cells.build_cells(items.limit(0), "l2"), asked, 3).count() == 0
    assert cells.search(cells.build_cells(items, "ip"), asked.limit(0), 3).count() == 0
    same = items.select("item_id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    found = cells.search(cells.build_cells(same, "cosine", part_rows=7), same.limit(2).withColumnRenamed("item_id", "query_id"), 4).collect()
    assert {r.item_id for r in found} == {0, 1, 2, 3}  # all alike: one cell in many parts, the smallest ids
    with pytest.raises(ValueError, match="metric"):
        cells.build_cells(items, "dot")
