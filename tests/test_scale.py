import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tetrarank.operators import blocks, dense, evaluation, scale
from tetrarank.plans import training


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows, a third of them in one group, many equal values, one null group key."""
    rng = np.random.default_rng(1)
    group = np.where(np.arange(6000) % 3 == 0, "hot", [f"g{i}" for i in rng.integers(0, 300, 6000)])
    frame = pd.DataFrame({"g": group, "id": np.arange(6000), "v": np.round(rng.normal(size=6000) * 3, 1),
                          "y": rng.integers(0, 2, 6000)})
    frame.loc[frame["g"] == "g7", "g"] = None
    return frame, spark.createDataFrame(frame).repartition(5).checkpoint()


def test_value_rank(skewed):
    frame, df = skewed
    got = scale.value_rank(df, ["g"], "v", ["id"], "rank").toPandas().set_index("id").sort_index()
    want = frame.sort_values(["v", "id"], ascending=[False, True]).groupby("g", dropna=False).cumcount() + 1
    assert (got["rank"] == want.sort_index()).all() and len(got) == len(frame)


def test_average_ranks(skewed):
    frame, df = skewed
    got = scale.average_ranks(df, ["g"], "v", "rank").toPandas().set_index("id").sort_index()
    assert np.allclose(got["rank"], frame.groupby("g", dropna=False)["v"].rank())


def test_exact_quantiles(skewed):
    frame, df = skewed
    got = scale.exact_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}).toPandas()
    got = got.assign(g=got["g"].fillna("-")).set_index("g").sort_index()
    want = frame.assign(g=frame["g"].fillna("-")).groupby("g")["v"].quantile([0, 0.1, 0.5, 0.93, 1]).unstack().sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())
    overall = scale.exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"]
    assert overall == pytest.approx(frame["v"].median())


def test_hash_rank_does_not_depend_on_partitions(skewed):
    _, df = skewed
    a = scale.hash_rank(df, ["g"], ["id"], "r").select("id", "r").toPandas().sort_values("id")
    b = scale.hash_rank(df.repartition(1), ["g"], ["id"], "r").select("id", "r").toPandas().sort_values("id")
    assert (a["r"].to_numpy() == b["r"].to_numpy()).all()


def test_running_totals_reverse(skewed):
    frame, df = skewed
    got = scale.running_totals(df, ["g"], [F.col("id")], F.floor(F.col("id") / 100), {"t": F.col("v")}, reverse=True)
    got = got.toPandas().set_index("id").sort_index()
    want = frame[::-1].groupby("g", dropna=False)["v"].cumsum().sort_index()
    assert np.allclose(got["t"], want)


def test_first_row_and_top_k(skewed):
    frame, df = skewed
    first = scale.first_row(df, ["g"], [-F.col("v"), F.col("id")]).toPandas()
    want = frame.sort_values(["v", "id"], ascending=[False, True]).groupby("g", dropna=False).head(1)
    assert set(first["id"]) == set(want["id"])
    top = scale.top_k(df, ["g"], [F.desc("v"), F.col("id")], 3).toPandas()
    assert set(top["id"]) == set(frame.sort_values(["v", "id"], ascending=[False, True]).groupby("g", dropna=False).head(3)["id"])


def test_auc(skewed):
    frame, df = skewed
    got = evaluation.auc(df, ["g"], "v", "y").toPandas()
    got = got.assign(g=got["g"].fillna("-")).set_index("g")["auc"]
    for g, rows in frame.assign(g=frame["g"].fillna("-")).groupby("g"):
        pos, neg = rows[rows.y == 1]["v"].to_numpy(), rows[rows.y == 0]["v"].to_numpy()
        if len(pos) and len(neg):
            want = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
            assert got[g] == pytest.approx(want)
        else:
            assert pd.isna(got[g])


def dot_scorer():
    def score(q, i):
        return blocks.list_matrix(q.column("v")) @ blocks.list_matrix(i.column("v")).T
    return score


def test_block_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[100:200] = x[0]  # a third of the items are copies, so ties must fall to the smaller id
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "v": x.tolist()}))
    q = rows.where("id < 40").withColumnRenamed("id", "q")
    scores = np.round(x[:40] @ x.T, 6)
    want = {(i, j) for i in range(40) for j in np.lexsort((np.arange(300), -scores[i]))[:7]}
    for options in ({}, {"broadcast_rows": 5, "block_rows": 11}):
        got = blocks.top_k_scores(q, rows, dot_scorer(), 7, query_id="q", item_id="id", **options).collect()
        assert {(r["q"], r["id"]) for r in got} == want


def test_block_no_hits_and_empty(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    q = rows.withColumnRenamed("id", "q")
    nothing = blocks.top_k_scores(q, rows, lambda a, b: np.full((a.num_rows, b.num_rows), -np.inf), 3, query_id="q", item_id="id")
    assert nothing.count() == 0
    assert blocks.top_k_scores(q.limit(0), rows, dot_scorer(), 3, query_id="q", item_id="id").count() == 0


def test_buckets_follow_the_order_and_keep_nulls(spark):
    values = [None, float("-inf"), -1e300, -5e6, -70.0, -0.1, 0.0, 1e-9, 0.1, 64.0, 64.1, 1e5, 1e6, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    buckets = [r["b"] for r in df.select("id", scale.value_bucket(F.col("v")).alias("b")).orderBy("id").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 10
    ranks = scale.value_rank(df.withColumn("g", F.lit(1)), ["g"], "v", ["id"], "rank").orderBy("id").collect()
    assert [r["rank"] for r in ranks] == list(range(16, 0, -1))


def test_equal_values_are_split(spark):
    """One group, one value: the same ranks as a sort, and no bucket holds more than a small share."""
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.lit(1.5).alias("v"), (F.col("id") * 7919 % 20_000).alias("i"))
    ranked = scale.value_rank(rows, ["g"], "v", ["i"], "rank")
    assert ranked.where(F.col("rank") != F.col("i") + 1).count() == 0 and ranked.count() == 20_000
    sizes = [r["count"] for r in rows.groupBy(scale.tie_bucket(rows, "i").alias("b")).count().collect()]
    assert len(sizes) > 1000 and max(sizes) < 200
    named = rows.select("g", "v", F.concat(F.lpad(F.col("i").cast("string"), 6, "0"), F.lit("-x")).alias("i"))
    assert scale.value_rank(named, ["g"], "v", ["i"], "rank").where(F.col("rank") != F.substring("i", 1, 6).cast("int") + 1).count() == 0


def test_running_totals_of_tied_values(spark):
    rows = spark.createDataFrame([("a", 2.0, 1, 10), ("a", 2.0, 2, 1), ("a", 1.0, 3, 5), ("a", None, 4, 7), ("b", 2.0, 5, 3)], "g string, v double, i long, x long")
    down = {r["i"]: r["t"] for r in scale.ranked_totals(rows, ["g"], "v", ["i"], {"t": F.col("x")}).collect()}
    up = {r["i"]: r["t"] for r in scale.ranked_totals(rows, ["g"], "v", ["i"], {"t": F.col("x")}, reverse=True).collect()}
    assert down == {1: 10, 2: 11, 3: 16, 4: 23, 5: 3} and up == {1: 23, 2: 13, 3: 12, 4: 7, 5: 3}


def test_design_of_short_and_long_prompts(spark, monkeypatch):
    """Prompts of few pairs are one aggregate without running counts; larger ones give the same numbers."""
    from tetrarank.operators import evaluation
    rng = np.random.default_rng(5)
    rows = [(p, f"{p}_{i}", None if i % 4 == 3 else "ab"[i % 2], ["easy", "hard", "x"][i % 3], int(i % 2), *[None if (i + p) % 6 == 0 else float(round(z, 3)) for z in rng.normal(size=4)])
            for p, n in ((1, 30), (2, 7), (3, 1)) for i in range(n)]
    rows += [(None, "n", "a", "easy", 1, 0.1, 0.2, 0.3, 0.4), (4, "none", "a", "easy", 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "prompt_id long, pair_id string, category string, difficulty string, y int, " + ", ".join(f"dz_{e} double" for e in ("alpha", "beta", "gamma", "delta")))

    def design():
        out = evaluation.prompt_design(df, ["category"], [], ["easy", "hard", "unknown"])
        return {r["prompt_id"]: r.asDict() for r in out.collect()}

    monkeypatch.setattr(scale, "GROUP_ROWS", 5)
    want = design()
    monkeypatch.undo()
    monkeypatch.setattr(evaluation, "exact_quantiles", None)
    got = design()
    assert set(got) == set(want) == {1, 2, 3}
    for p, row in want.items():
        assert all(got[p][c] == (pytest.approx(x) if isinstance(x, float) else x) for c, x in row.items())


def test_balanced_positions_rank_only_the_last_bucket(spark, monkeypatch):
    """The first rows in md5 order are flipped, repeated keys too, and no rank over all rows is made."""
    from tetrarank.operators import splits
    rows = [(g, i // r, (i * 7) % 10 < k, i, 1000 + i, "easy" if i % 3 else "hard") for g, k, r in (("a", 8, 1), ("b", 2, 3), (None, 9, 1), ("c", 10, 60)) for i in range(60)]
    df = spark.createDataFrame([(g, k, int(y), a, b, d, float(a), 0.0, 0.0, 0.0) for g, k, y, a, b, d in rows],
                               "g string, k long, y int, movieA long, movieB long, difficulty string, dz_alpha double, dz_beta double, dz_gamma double, dz_delta double")
    monkeypatch.setattr(splits, "hash_rank", None)
    for easy in (False, True):
        out = splits.balance_positions(df, ["g"], ["k"], 0.5, easy).toPandas()
        assert out.columns.tolist() == df.columns and len(out) == len(rows)
        frame = df.toPandas()
        frame["h"] = [hashlib.md5(f"42|{k}".encode()).hexdigest() for k in frame.k]
        for g, own in frame.groupby("g", dropna=False):
            ok = own[own.difficulty == "easy"] if easy else own
            surplus = int(ok.y.sum() - round(0.5 * len(ok)))
            first = ok[ok.y == (1 if surplus > 0 else 0)].sort_values("h").h.tolist()[:abs(surplus)]
            mine = out[out.movieA.between(1000, 1060) & (out.g.isna() if g != g or g is None else out.g == g)]
            assert sorted(hashlib.md5(f"42|{k}".encode()).hexdigest() for k in mine.k) == first


def test_cells_meet_in_turns(spark, monkeypatch):
    """Where copies of the rows for a grid of cells are too many, blocks of items take turns; the rows are the same."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))] + [(7, [9.0, 9.0, 9.0, 9.0])], "item_id long, vector array<double>")
    asked = rows.where("item_id < 60").withColumnRenamed("item_id", "query_id")
    want = sorted(map(tuple, dense.search(asked, rows, 5).collect()))
    options = {"query_id": "query_id", "item_id": "item_id", "broadcast_rows": 5, "block_rows": 20, "item_rows": 50}
    written = []
    monkeypatch.setattr(blocks, "stored", lambda df, label: written.append(label) or scale.stored(df, label))
    for bytes_at_once, turns in ((1 << 30, 0), (20_000, 3), (1, 7)):
        monkeypatch.setattr(blocks, "MOVED_BYTES", bytes_at_once)
        written.clear()
        got = sorted(map(tuple, blocks.top_k_scores(asked, rows, dense._Vectors("cosine"), 5, **options).collect()))
        assert got == want and (written.count("hits") > 1 if turns else not written)


def test_a_fit_leaves_no_long_lineage(spark):
    """Shuffle files of a step can be deleted while later ones run: the factors depend on the last step only."""
    rng = np.random.default_rng(8)
    ratings = spark.createDataFrame([(int(u), int(i), 5.0) for u in range(30) for i in set(rng.integers(0, 20, 5).tolist())], "user_id int, item_id int, rating double")
    users = [training.fit_factors(ratings, rank=3, max_iter=n)[0] for n in (2, 6)]
    short, long = [u._jdf.queryExecution().toRdd().toDebugString().count("ALS.scala") for u in users]
    assert long <= short
