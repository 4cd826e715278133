import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS, EXPERTS
from tetrarank.operators import mining, preferences, splits, targets
from tetrarank.plans import training


def generated(prompts=40, per_prompt=8, seed=0):
    """Pairs with y = sign(mix . dz + noise)."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(prompts):
        mix = rng.dirichlet(np.ones(4))
        for i in range(per_prompt):
            dz = rng.normal(0.2, 0.5, 4)
            rows.append((p, f"{p}_{i}", int(mix @ dz + rng.normal(0, 0.1) > 0), *dz,
                         ["action", "drama", "family", "sci-fi"][p % 4], ["easy", "medium", "hard"][i % 3], 2 * p, 2 * p + 1, *mix))
    return pd.DataFrame(rows, columns=["prompt_id", "pair_id", "y", *DZ_COLUMNS, "category", "difficulty", "movieA", "movieB",
                                       *[f"mix_{e}" for e in EXPERTS]])


@pytest.fixture(scope="module")
def pairs(spark):
    frame = generated()
    return frame, spark.createDataFrame(frame).checkpoint()


def test_difference_features_drop_missing_and_flat(spark):
    scored = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 2.0), (1, 2, 0.5, 0.0, 0.0, 1.0), (1, 3, 0.5, 0.0, 0.0, 1.0)],
                                   "prompt_id long, item_id long, z_alpha double, z_beta double, z_gamma double, z_delta double")
    p = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 2, 3), (1, "c", 1, 9)], "prompt_id long, pair_id string, movieA long, movieB long")
    got = preferences.difference_features(p, scored).collect()
    assert [(r["pair_id"], r["dz_alpha"], r["dz_delta"]) for r in got] == [("a", 0.5, 1.0)]


def test_one_to_one_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k long, b string")
    assert [tuple(r) for r in preferences.join_one_to_one(a, b, ["k"]).collect()] == [(1, "x", "p")]
    assert preferences.duplicate_keys(a.union(a), ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        preferences.join_one_to_one(a.union(a), b, ["k"]).collect()


def test_canonical_family_falls_back(spark, pairs):
    _, df = pairs
    zero = df.select("prompt_id", "pair_id", *[F.lit(0.0).alias(c) for c in DZ_COLUMNS])
    out = preferences.combined_features(df, zero).select("pair_id", "dz_alpha", "sum_dz_alpha", "attn_entropy").collect()
    assert all(r["dz_alpha"] == r["sum_dz_alpha"] for r in out) and len(out) == 320


def test_split_is_exact_and_leak_free(pairs):
    frame, df = pairs
    out = splits.split_by_group(df, ["prompt_id"], ["category"])
    assert splits.split_integrity(out, ["prompt_id"]).count() == 0
    counts = out.select("prompt_id", "category", "split").distinct().groupBy("category").pivot("split").count().toPandas()
    assert (counts.train == 7).all() and (counts.val == 1).all() and (counts.test == 2).all()
    again = splits.split_by_group(df.repartition(7), ["prompt_id"], ["category"])
    assert out.select("pair_id", "split").exceptAll(again.select("pair_id", "split")).count() == 0


def test_balance_reaches_target_and_is_idempotent(pairs):
    frame, df = pairs
    out = splits.balance_positions(df, ["category", "difficulty"], ["pair_id"]).checkpoint()
    for (c, d), rows in out.toPandas().groupby(["category", "difficulty"]):
        assert rows.y.sum() == round(0.5 * len(rows))
    assert splits.balance_positions(out, ["category", "difficulty"], ["pair_id"]).exceptAll(out).count() == 0
    flipped = out.join(df.select("pair_id", F.col("y").alias("y0"), F.col("dz_beta").alias("b0"), F.col("movieA").alias("a0")), "pair_id")
    wrong = flipped.where("(y <> y0) <> (dz_beta = -b0) or (y <> y0) <> (movieA <> a0)")
    assert wrong.count() == 0
    twice = splits.flipped(splits.flipped(df, F.lit(True)), F.lit(True))
    assert twice.exceptAll(df).count() == 0


def test_shuffle_scope(pairs):
    _, df = pairs
    rows = splits.split_by_group(df, ["prompt_id"], ["category"])
    out = splits.shuffle_positions(rows, ["pair_id"], 1.0, "train", only_easy=True)
    joined = out.join(df.select("pair_id", F.col("y").alias("y0")), "pair_id")
    assert joined.where("(y <> y0) <> (split = 'train' and difficulty = 'easy')").count() == 0
    assert splits.shuffle_positions(rows, ["pair_id"], 1.0, "none") is rows


def chunk_loop(total, smallest, largest):
    out, remaining = [], total
    while remaining > 0:
        size = min(largest, remaining)
        while size > smallest and 0 < remaining - size < smallest:
            size -= 1
        if size < smallest and remaining != total:
            size = remaining
        out.append(size)
        remaining -= size
    return out


def test_batch_sizes_match_the_loop():
    for smallest, largest in ((1, 1), (3, 5), (8, 12), (8, 10), (5, 5)):
        for total in range(1, 60):
            full, before, last = splits.batch_sizes(total, smallest, largest)
            got = [largest] * full + ([before] if before else []) + ([last] if last else [])
            assert got == chunk_loop(total, smallest, largest), (total, smallest, largest)


def test_folds(spark, pairs):
    _, df = pairs
    by_rank = splits.fold_by_rank(df, ["pair_id"], ["category"], 4).groupBy("category", "fold").count().toPandas()
    assert (by_rank["count"] == 20).all()
    cats = spark.createDataFrame([(i, f"c{min(i // 10, 6)}") for i in range(100)], "id long, c string").withColumn("b", F.lit(0))
    folded = splits.assign_folds(cats, ["id"], "c", "b", 3)
    assert folded.select("c", "fold").distinct().count() == 7
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [30, 30, 40]


def test_entropy_bins_like_qcut(spark):
    values = np.round(np.random.default_rng(4).gamma(2, 1, 200), 1)
    out = splits.entropy_bins(spark.createDataFrame(pd.DataFrame({"x": values})), "x").toPandas()
    want = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop")
    assert dict(zip(out.x, out.entropy_bin)) == dict(zip(values, want))
    flat = splits.entropy_bins(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x")
    assert {r["entropy_bin"] for r in flat.collect()} == {0}


def test_folds_equal_a_walk():
    """Any number of equal sizes: the fold of each category is the one a plain walk gives."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = np.sort(rng.integers(1, 6, rng.integers(1, 40)))[::-1]
        loads, walk = [0, 0, 0], []
        for n in sizes.tolist():
            walk.append(loads.index(min(loads)))
            loads[walk[-1]] += n
        held, at = np.zeros(3, np.int64), 0
        for n in sorted(set(sizes.tolist()), reverse=True):
            m = int((sizes == n).sum())
            found = splits._fold_of(np.tile(held, (m, 1)), np.full(m, n), np.arange(m))
            assert found.tolist() == walk[at:at + m]
            held, at = held + n * splits._given(held, n, m), at + m
        assert held.tolist() == loads


def test_one_hot(spark):
    rows = spark.createDataFrame([(1, "B b", 2.0), (2, None, None), (3, " a ", 1.0)], "prompt_id long, c string, n double")
    levels = splits.fit_levels(rows, ["c"])
    assert levels == {"c": ["unknown", "a", "b b"]}
    wide = splits.one_hot(rows, levels, ["n", "absent"]).orderBy("prompt_id").collect()
    assert list(wide[0].asDict()) == ["prompt_id", "X_c__unknown", "X_c__a", "X_c__b_b", "X_absent", "X_n"]
    assert [tuple(r) for r in wide] == [(1, 0, 0, 1, 0, 2.0), (2, 1, 0, 0, 0, 0.0), (3, 0, 1, 0, 0, 1.0)]


def newton(x, y, strength):
    n, pos = len(y), y.sum()
    sw = strength * np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (sw * p * (1 - p))[:, None]).T @ x + np.eye(4), x.T @ (sw * (p - y)) + w)
    return w


def test_prompt_targets(spark):
    frame = generated(12, 40, seed=3)
    frame.loc[frame.prompt_id == 0, "y"] = 1                     # one class only
    frame = frame[(frame.prompt_id != 1) | (frame.index % 40 < 4)]  # too few pairs
    df = spark.createDataFrame(frame)
    got = {r["prompt_id"]: r for r in targets.prompt_targets(df).collect()}
    assert len(got) == 12
    for p in (0, 1):
        assert got[p]["source"] == "uniform" and got[p]["w_beta"] == 0.25
    for p in range(2, 12):
        rows = frame[frame.prompt_id == p]
        w = np.log1p(np.exp(newton(rows[DZ_COLUMNS].to_numpy(), rows.y.to_numpy(), 5.0)))
        assert got[p]["source"] == "logit"
        assert np.allclose([got[p][c] for c in targets.WEIGHTS], w / (w.sum() + 1e-8), atol=1e-6)
    mixed = targets.mixture_targets(df).collect()
    assert all(sum(r[c] for c in targets.WEIGHTS) == pytest.approx(1.0) for r in mixed)


def test_mined_pairs_keep_the_rules(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"prompt_id": np.repeat([1, 2, 3], [900, 300, 6]), "item_id": np.arange(1206), "score": rng.uniform(0, 1, 1206)})
    pools = frame.assign(rank=frame.groupby("prompt_id").score.rank(ascending=False, method="first"))
    got = mining.mine_pairs(spark.createDataFrame(frame)).toPandas()
    assert got.pair_id.is_unique and set(got[got.prompt_id < 3].groupby("prompt_id").size()) == {9}
    for p, rows in got.groupby("prompt_id"):
        uses = pd.concat([rows.movieA, rows.movieB]).value_counts()
        assert uses.max() <= 3 and (rows.movieA != rows.movieB).all()
        assert len({frozenset(x) for x in zip(rows.movieA, rows.movieB)}) == len(rows)
    gap = (got.score_a - got.score_b).abs()
    big = got.prompt_id < 3
    assert gap[big & (got.difficulty == "medium")].between(0.2, 0.5).all() and (gap[big & (got.difficulty == "hard")] < 0.2).all()
    rank = pools.set_index("item_id")["rank"]
    easy = got[(got.prompt_id == 1) & (got.difficulty == "easy")]
    assert (rank[easy.movieA] <= 90).all() and (rank[easy.movieB] > 810).all()
    assert ((got.score_a >= got.score_b) == (got.m1_gt_m2 == 1)).all()


def test_short_and_long_prompts_are_fitted_alike(spark, monkeypatch):
    """Prompts that fit a task are fitted without a pass per step; nulls count as in the sums of the passes."""
    rng = np.random.default_rng(9)
    rows = [(p, None if i == 5 else int(rng.uniform() < 0.6), *[None if i == 7 and j == (p or 0) % 4 else float(z) for j, z in enumerate(rng.normal(size=4))])
            for p, n in (*[(q, 30) for q in range(40)], (50, 3000), (51, 1), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "prompt_id long, y int, dz_alpha double, dz_beta double, dz_gamma double, dz_delta double")
    base = targets.stored_pairs(df)
    want = {r["prompt_id"]: r for r in targets._logits_by_passes(base, 5.0, 1e-9, 60).collect()}
    monkeypatch.setattr(targets, "_logits_by_passes", None)
    got = {r["prompt_id"]: r for r in targets.prompt_logits(base, 5.0).collect()}
    assert set(got) == set(want) and len(want) >= 40
    for p, r in want.items():
        assert (got[p]["n"], got[p]["pos"], got[p]["converged"]) == (r["n"], r["pos"], r["converged"])
        assert [got[p][f"c{i}"] for i in range(4)] == pytest.approx([r[f"c{i}"] for i in range(4)], abs=1e-7)


def test_short_and_long_lists_are_mined_alike(spark, monkeypatch):
    """Lists that fit a task meet no table of pairs, and the tables give the same pairs; nulls pair with nothing."""
    rng = np.random.default_rng(8)
    rows = [(p, i, float(round(x, 2))) for p, n in ((1, 130), (2, 40), (3, 6), (4, 1)) for i, x in enumerate(rng.uniform(0, 1, n))]
    rows += [(2, None, 0.5), (2, 77, None), (3, 50, None), (None, 1, 0.1), (None, 2, 0.9), (5, 1, None), (5, 2, None), (5, 3, None), (6, 1, float("nan")), (6, 2, 0.5), (6, 3, 0.6)]
    scored = spark.createDataFrame(rows, "prompt_id long, item_id long, score double")
    monkeypatch.setattr(mining, "LIST_ROWS", 0)
    want = sorted(map(str, mining.mine_pairs(scored).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(mining, "candidate_pairs", None)
    got = sorted(map(str, mining.mine_pairs(scored).collect()))
    assert got == want and len(got) > 20


def test_nested_batches(pairs):
    _, df = pairs
    nested = preferences.nested_pairs(df.select("prompt_id", "pair_id", "y"), batch=3)
    rows = nested.collect()
    assert max(r["n_pairs"] for r in rows) == 3 and sum(r["n_pairs"] for r in rows) == 320


def test_linear_ranker_and_heads(spark, pairs):
    frame, df = pairs
    weights = training.fit_linear_ranker(df)
    scored = df.withColumn("margin", training.linear_margin(weights)).toPandas()
    assert ((scored.margin > 0) == (scored.y == 1)).mean() > 0.75
    assert sum(abs(w) for w in training.l1_normalized(weights)) == pytest.approx(1.0)
    design = df.groupBy("prompt_id").agg(*[F.avg(c).alias(c) for c in DZ_COLUMNS], *[F.first(f"mix_{e}").alias(f"mix_{e}") for e in EXPERTS])
    design = splits.fold_by_rank(design, ["prompt_id"], [], 3).persist()
    metrics, predicted = training.cross_validate(design, df, DZ_COLUMNS, [f"mix_{e}" for e in EXPERTS], 3, trees=2)
    assert metrics.agg(F.avg("accuracy")).first()[0] >= 0.6
    sums = predicted.select(sum((F.col(f"pred_{e}") for e in EXPERTS), F.lit(0.0)).alias("s")).collect()
    assert len(sums) == 40 and all(r["s"] == pytest.approx(1.0, abs=1e-6) for r in sums)


def test_gated_mixture_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 6))
    mix = rng.dirichlet(np.ones(4), 20)
    p = {"w1": rng.normal(size=(5, 6)), "b1": rng.normal(size=5), "w2": rng.normal(size=(4, 5)), "b2": rng.normal(size=4), "a": rng.normal(size=4),
         "b": rng.normal(size=4), "bias": rng.normal(size=6), "bias0": 0.3, "temp": 0.1, "mix_scale": 9.0, "mix_margin": rng.normal(size=4)}
    rows = spark.createDataFrame([(i, x[i].tolist(), *map(float, mix[i])) for i in range(20)],
                                 "id long, x array<double>, mix_alpha double, mix_beta double, mix_gamma double, mix_delta double")
    got = training.gated_mixture(rows, "x", p).toPandas().sort_values("id")
    logits = (np.maximum(x @ p["w1"].T + p["b1"], 0) @ p["w2"].T + p["b2"]) / 0.2 + 5.0 * np.log(mix)
    w = np.exp(logits - logits.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    margin = (w * (p["a"] * x[:, :4] + p["b"])).sum(1) + x @ p["bias"] + 0.3 + mix @ p["mix_margin"]
    assert np.allclose(got.margin, margin) and np.allclose(got[[f"w_{e}" for e in EXPERTS]], w)
