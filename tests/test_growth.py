"""What must not grow with the input: bytes of an index, tokens counted at once, rows sent to cells and users."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tetrarank.functions import text as tx
from tetrarank.operators import blocks, bm25, cells, dense, embed, postings
from tetrarank.workloads import preference


def test_sides_of_a_block_are_prepared_once():
    class Counted(dense._Vectors):
        made = 0

        def right(self, items):
            Counted.made += 1
            return super().right(items)

    rng = np.random.default_rng(3)
    for metric in ("ip", "cosine", "l2"):
        x, q = rng.normal(size=(3 * blocks.ITEM_ROWS, 8)), rng.normal(size=(2 * blocks.QUERY_ROWS + 7, 8))
        x[::9] = x[0]  # many ties
        x[5], Counted.made = np.nan, 0
        items = pa.table({"item_id": np.arange(len(x)), "vector": x.tolist()})
        found = blocks._score_batches(pa.table({"vector": q.tolist()}), iter([items]), Counted(metric), "item_id", 6, None)
        assert Counted.made == 3
        with np.errstate(all="ignore"):
            scores = np.round(dense._Vectors(metric)(pa.table({"vector": q.tolist()}), items), 6) + 0.0
        row, at = blocks._best(scores, np.arange(len(x)), 6)
        assert (found[0] == row).all() and (found[2] == at).all() and np.allclose(found[1], scores[row, at], atol=2e-6)


def test_genre_parts_are_made_once_per_set_of_genres():
    items = pa.table({"genres": [["a", "b"], ["b", "a", "a"], [], None, ["c"]] * 3, "title_tokens": [["x"]] * 15, "item_emo": [[1.0]] * 15})
    right = embed._Proxy().right(items)
    assert right["codes"]["genres"][2] == 3 and right["kind"].tolist() == [0, 0, 1, 1, 2] * 3


def test_a_query_goes_once_to_a_group_of_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_ITEMS", 150)
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 6)))], "item_id long, vector array<double>")
    index = cells.build_cells(items, "l2", cells=30)
    known = index.cells.toArrow()
    groups = cells._groups(known)
    assert 4 <= len(set(groups.column("g").to_pylist())) <= 6
    fields = pa.schema([("query_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("least", pa.float64()), ("g", pa.int32()), ("cells", pa.list_(pa.int32()))])
    asked = pa.RecordBatch.from_pydict({"query_id": [1], "vector": [[0.0] * 6], "least": pa.array([None], pa.float64())})
    rows = pa.Table.from_batches(cells._visits(known, groups, "l2", 3, fields, False)(iter([asked])))
    assert rows.num_rows <= 6 and sum(len(x) for x in rows.column("cells").to_pylist()) >= 25
    asked = items.where("item_id < 40").withColumnRenamed("item_id", "query_id")
    got, want = (sorted(map(tuple, x.select("query_id", "item_id").collect())) for x in (cells.search(index, asked, 5), dense.search(asked, items, 5, metric="l2")))
    assert got == want


def test_an_entry_of_the_index_takes_six_bytes(spark):
    docs = spark.createDataFrame([(i, f"the w{i % 7} w{i % 5} the") for i in range(300)], "id bigint, text string")
    index = postings.build_index(docs, "id", F.col("text"), block_docs=40)
    worded = index.rows.where("term is not null").select(F.sum(F.length("entries")).alias("bytes"), F.sum("size").alias("n")).first()
    assert worded["bytes"] == 6 * worded["n"]


def test_tokens_are_counted_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(bm25, "TOKENS", 10, raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "tokens": [["a", "b", "a"], [], ["c"] * 25, None, ["a"] * 9, ["b"], ["c"], [], ["d"]]})
    pieces = list(bm25._count_words(iter([batch])))
    assert len(pieces) >= 3
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [r["dl"] for r in rows] == [3, 0, 25, 0, 9, 1, 1, 0, 1]
    assert [dict(zip(r["terms"], r["tfs"])) for r in rows[:3]] == [{"a": 2, "b": 1}, {}, {"c": 25}]


def test_sentences_strip_without_patterns(spark):
    long = " ".join(["word"] * 59)
    rows = [(0, None), (1, "　 a \x85"), (2, f"\n\n{long} End. Next one "), (3, f"{long}. End"), (4, f"{long} end. Next"), (5, "a\n\n\n  \n\nb. C")]
    found = spark.createDataFrame(rows, "id int, text string").select("id", tx.sentences(F.col("text")).alias("s"))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.s for r in found.collect()}
    assert got == {0: [], 1: ["a"], 2: [f"{long} End.", "Next one"], 3: [f"{long}.", "End"], 4: [f"{long} end.", "Next"], 5: ["a", "b. C"]}


def test_a_rating_is_one_row_of_the_residual(spark, tmp_path):
    rng = np.random.default_rng(4)
    orders = [(i, i % 20) for i in range(200)]
    lines = [(i, int(p), float(10 + rng.integers(0, 40))) for i in range(200) for p in rng.integers(0, 15, 3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    found = preference.factor_optimum(spark, f"file://{tmp_path}")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert tuple(found.first()) == (20, 0.0)
