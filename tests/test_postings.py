"""The posting-block index: rows of the flat search, blocks that are not read, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.functions import text as tx
from tetrarank.operators import bm25, postings, runs


def topics(n=400):
    """Documents of topics in runs of 40: what a block holds tells it apart from others."""
    rng = np.random.default_rng(5)
    common = ["the", "of", "and"]
    return [(i, " ".join([*rng.choice(common, 5), *[f"t{i // 40}w{j}" for j in rng.integers(0, 12, int(rng.integers(0, 20)))]])) for i in range(n)]


ODD = [(1000, None), (1001, ""), (1002, "!!! ..."), (1003, "The THE the É t1w1"), (1004, "t1w1 " * 3000), (1005, "of"), (1005, "of")]
ASKED = [(1, "t1w1 t1w2 the"), (2, "the of and"), (3, "t3w1 t3w1 t7w2"), (4, "unknown"), (5, None), (6, "of t9w0 t9w1 t9w2 t9w3")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(topics() + ODD, "id bigint, text string").coalesce(1)
    return docs, spark.createDataFrame(ASKED, "query_id bigint, text string")


@pytest.mark.parametrize(("negative", "k", "unsorted"), [("keep", 1, 0), ("keep", 7, 1 << 60), ("floor_avg", 7, 0), ("floor_avg", 500, 0)])
def test_same_rows_as_the_flat_search(spark, tables, tmp_path, monkeypatch, negative, k, unsorted):
    docs, asked = tables
    monkeypatch.setattr(postings, "UNSORTED_BYTES", unsorted)  # rows of the index by word, or as they come
    flat = bm25.search(bm25.build_index(docs, "id", tx.tokens(F.col("text"))), asked, k, negative=negative)
    want = sorted((r.query_id, r.doc_id, r.score) for r in flat.collect())
    postings.build_index(docs, "id", tx.or_empty(F.col("text")), f"file://{tmp_path}/index", block_docs=20)
    index = postings.PostingIndex.read(spark, f"file://{tmp_path}/index")
    assert index.stats.first()["n_docs"] == len(topics()) + len(ODD)
    for prune_from in (0, 10**6):  # with bounds first, and all blocks at once
        got = sorted((r.query_id, r.doc_id, r.score) for r in postings.search(index, asked, k, negative=negative, prune_from=prune_from).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_most_blocks_are_not_read(spark, tables):
    docs, asked = tables
    index = postings.build_index(docs, "id", tx.or_empty(F.col("text")), block_docs=20)
    report = {}
    postings.search(index, asked.where("query_id in (1, 3, 6)"), 3, prune_from=0, report=report).collect()
    blocks = index.rows.where("term is null").count()
    assert blocks >= 20 and report["pairs"] > 2 * blocks  # frequent words are everywhere
    assert report["read"] <= 0.35 * report["pairs"]


def test_sets_of_queries_and_nothing(spark, tables, monkeypatch):
    docs, asked = tables
    index = postings.build_index(docs, "id", tx.or_empty(F.col("text")), block_docs=20)
    whole = sorted(map(tuple, postings.search(index, asked, 5).collect()))
    monkeypatch.setattr(postings, "QUERY_TERMS", 5)
    assert sorted(map(tuple, postings.search(index, asked, 5, prune_from=0).collect())) == whole and len(whole) > 12
    assert postings.search(index, asked.limit(0), 5).count() == 0
    empty = postings.build_index(docs.limit(0), "id", tx.or_empty(F.col("text")))
    assert postings.search(empty, asked, 5).count() == 0


def test_bounds_come_from_pairs_that_none_beats():
    rng = np.random.default_rng(0)
    group = np.sort(rng.integers(0, 30, 400))
    group = np.searchsorted(np.unique(group), group)
    tf, dl = rng.integers(1, 9, 400), rng.integers(1, 50, 400)
    best = postings.best_pairs(group, tf, dl)
    gain = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 20))
    for g in range(group.max() + 1):
        assert gain[group == g].max() == gain[best[group[best] == g]].max()
    assert len(best) < 200


def test_runs_do_not_cross_texts():
    import pyarrow as pa

    table = runs.byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), high=True, lower=True)
    found, row = runs.byte_runs(pa.array([b"Ab c", None, b"", b"1", "ß_É".encode()], pa.binary()), table)
    assert found.to_pylist() == [b"ab", b"c", b"1", "ß".encode(), "É".encode()] and row.tolist() == [0, 0, 3, 4, 4]
