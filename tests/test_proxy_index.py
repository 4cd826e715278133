"""Proxy scores over the inverted index: the rows of the flat search, items that are not scored."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tetrarank.operators import blocks, embed, proxy_index

GENRES = ["Drama", "Comedy", "War", "Crime", "Horror", "Romance"]
ITEMS = "item_id long, genres array<string>, title_tokens array<string>, item_emo array<double>"
PROMPTS = ("prompt_id long, target_genres array<string>, negative_genres array<string>, prompt_tokens array<string>, liked_genres array<string>, "
           "disliked_genres array<string>, prompt_emo array<double>, w_alpha double, w_beta double, w_gamma double, w_delta double")


def pick(rng, values, most):
    return [values[i] for i in rng.permutation(len(values))[:rng.integers(0, most + 1)]]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, pick(rng, GENRES, 2), pick(rng, words, 3), rng.dirichlet(np.ones(8)).tolist()) for i in range(500)] + [(900, None, None, [0.125] * 8), (901, ["War", "War"], [], [0.0] * 8)]
    prompts = [(i, pick(rng, GENRES, 2), pick(rng, GENRES, 1), pick(rng, words, 4) * 2, pick(rng, GENRES, 3), pick(rng, GENRES, 1), rng.dirichlet(np.ones(8)).tolist(),
                *(rng.dirichlet(np.ones(4)) if i else np.array([0.7, 0.3, 0.0, 0.0])).tolist()) for i in range(25)]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(prompts, PROMPTS)


@pytest.mark.parametrize(("k", "part_rows"), [(1, 10), (8, 2000), (600, 50)])
def test_same_rows_as_the_flat_search(spark, tables, tmp_path, k, part_rows):
    items, prompts = tables
    proxy_index.build_index(items, part_rows=part_rows, path=f"file://{tmp_path}/index")
    report = {}
    got = {(r.prompt_id, r.item_id): r.combined for r in proxy_index.search(proxy_index.ProxyIndex.read(spark, f"file://{tmp_path}/index"), prompts, k, report=report).collect()}
    want = {(r.prompt_id, r.item_id): r.combined for r in embed.proxy_top_items(prompts, items.na.fill({}), k).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 2e-6 for x in got)
    assert report["pairs"] == 25 * 502
    if k == 1:
        assert report["scored"] < 0.4 * report["pairs"]
    if k == 600:
        assert report["scored"] == report["pairs"]


def test_nothing(spark, tables):
    items, prompts = tables
    assert proxy_index.search(proxy_index.build_index(items.limit(0)), prompts, 3).count() == 0
    assert proxy_index.search(proxy_index.build_index(items), prompts.limit(0), 3).count() == 0


def test_a_prompt_goes_once_to_a_group_of_cells(spark, tables, monkeypatch):
    for name, value in (("GROUP_ITEMS", 90), ("GROUP_CELLS", 12), ("BLOCK_PROMPTS", 7), ("SENT_ROWS", 40), ("WORDS", 3), ("BOUNDS", 100)):
        monkeypatch.setattr(proxy_index, name, value)
    items, prompts = tables
    index = proxy_index.build_index(items, part_rows=10)
    cells = index.cells.toArrow()
    group = proxy_index._groups(cells, 90)
    sizes = np.bincount(group, weights=cells.column("size").to_numpy())
    assert len(group) > 60 and np.bincount(group).max() <= 12 and sizes.sum() == 502 and sizes.max() < 110
    asked = prompts.select("prompt_id", *proxy_index.COLUMNS, F.lit(1).alias("n"), F.lit(None).cast("double").alias("least")).toArrow()
    fields = pa.schema([*asked.schema, ("g", pa.int32()), ("cells", pa.list_(pa.int32()))])
    known = proxy_index._Cells(cells, group)
    rows = pa.Table.from_batches(proxy_index._visits(known, 8, fields, False)(iter(asked.to_batches())))
    assert rows.num_rows == 25 * len(sizes) and rows.column("cells").null_count == rows.num_rows  # no cell is listed, though all are in reach
    rows = pa.Table.from_batches(proxy_index._visits(known, 8, fields, True)(iter(asked.to_batches())))
    assert sum(len(x) for x in rows.column("cells").to_pylist()) <= 25 * 8

    same = prompts.where("prompt_id < 6")
    prompts = prompts.unionByName(same).unionByName(same.withColumn("prompt_id", F.lit(None).cast("long")))  # ids that repeat or are null
    got, want = (sorted(((str(r.prompt_id), r.item_id, r.combined) for r in x.collect())) for x in (proxy_index.search(index, prompts, 8), embed.proxy_top_items(prompts, items.na.fill({}), 8)))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    assert len(got) == 26 * 8


def _block(rng, n_prompts, n_items, words, emotions):
    lists = pa.list_(pa.string())
    prompts = {c: pa.array([pick(rng, GENRES, 2) for _ in range(n_prompts)], lists) for c in ("target_genres", "negative_genres", "liked_genres", "disliked_genres")}
    prompts |= {"prompt_tokens": pa.array([pick(rng, words, 4) * 2 for _ in range(n_prompts)], lists), "prompt_emo": emotions(n_prompts).tolist()}
    prompts |= {f"w_{e}": np.full(n_prompts, x) for e, x in zip(embed.EXPERTS, (0.4, 0.3, 0.2, 0.1))}
    items = {"item_id": rng.permutation(n_items), "genres": pa.array([pick(rng, GENRES, 2) if i % 50 else None for i in range(n_items)], lists),
             "title_tokens": pa.array([pick(rng, words, 3) for _ in range(n_items)], lists), "item_emo": emotions(n_items).tolist()}
    return pa.table(prompts), pa.table(items)


@pytest.mark.parametrize("case", ["bounded", "negative", "nan", "few"])
def test_flat_search_skips_items_out_of_reach(monkeypatch, case):
    rng = np.random.default_rng(11)
    emotions = (lambda n: rng.normal(size=(n, 8))) if case == "negative" else lambda n: rng.dirichlet(np.ones(8), size=n)
    prompts, items = _block(rng, 90, 5 if case == "few" else 6000, [f"w{i}" for i in range(20)], emotions)
    if case == "negative":  # weights of either sign
        for e in embed.EXPERTS:
            prompts = prompts.set_column(prompts.schema.get_field_index(f"w_{e}"), f"w_{e}", pa.array(rng.normal(size=90)))
    if case == "nan":
        items = items.set_column(3, "item_emo", pa.array([[np.nan] * 8, *items.column("item_emo").to_pylist()[1:]]))
    scores = np.round(embed._proxy_matrix(prompts, items), blocks.DECIMALS) + 0.0
    q, i = blocks._best(scores, items.column("item_id").to_numpy(), 7)
    met, full = [], embed._Proxy.scores
    monkeypatch.setattr(embed._Proxy, "scores", lambda self, left, right: met.append(full(self, left, right)) or met[-1])
    got = blocks._score_batches(prompts, iter([items]), embed._proxy_matrix, "item_id", 7, None)
    assert (got[0] == q).all() and (got[2] == items.column("item_id").to_numpy()[i]).all() and np.allclose(got[1], scores[q, i], atol=2e-6)
    if case == "bounded":
        assert not met  # no matrix of prompts and items


def test_blocks_of_queries_keep_cores_busy():
    assert blocks._grid(360_000, 7_200_000, 100_000, 300_000, 6) == (4, 24)
    assert blocks._grid(24_000, 480_000, 100_000, 300_000, 6) == (6, 2)
    assert blocks._grid(15_000, 20_000, 20_000, 200_000, 8) == (7, 1)
    assert blocks._grid(0, 0, 20_000, 200_000, 8) == (0, 1)
