"""Global ranks in buckets and ranges, the sparse design, checked joins, ranker steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.operators import preferences, scale, splits, targets
from tetrarank.plans import training
from tetrarank.sources import writers


@pytest.mark.parametrize("digits", [1, 4, 5, 9])
def test_hash_rank_is_the_same_for_any_number_of_buckets(spark, monkeypatch, digits):
    rows = spark.range(700).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g")).unionByName(spark.createDataFrame([(None, 0), (5, None)], "k long, g long"))
    plain = {(r.k, r.g): r.rank for r in scale.hash_rank(rows, ["g"], ["k"], "rank").collect()}
    monkeypatch.setattr(scale, "hash_digits", lambda n: digits)
    found = {(r.k, r.g): r.rank for r in scale.hash_rank(rows, ["g"], ["k"], "rank").collect()}
    assert found == plain and sorted(v for (_, g), v in plain.items() if g == 0) == list(range(1, 236))


def test_buckets_follow_the_rows():
    assert scale.hash_digits(10) == scale.hash_digits(16 ** 4 * 4096) == 4
    assert scale.hash_digits(10 ** 12) == 7 and scale.hash_digits(10 ** 18) == 11


def test_range_rank(spark):
    rng = np.random.default_rng(3)
    rows = [("a", f"same_prefix_{i:05d}") for i in rng.permutation(900)] + [("b", None), ("b", "x"), (None, "y")]
    found = scale.range_rank(spark.createDataFrame(rows, "g string, t string"), ["g"], ["t"], "rank").collect()
    of = {(r.g, r.t): r["rank"] for r in found}
    assert [of["a", f"same_prefix_{i:05d}"] for i in range(900)] == list(range(1, 901))
    assert of["b", None] == 1 and of["b", "x"] == 2 and of[None, "y"] == 1 and len(found) == len(rows)


def test_sparse_design_of_many_levels(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("L"), F.col("id") % 9000).alias("c"), F.when(F.col("id") % 5 > 0, "q").alias("d"), (F.col("id") % 2).alias("n"))
    levels = splits.level_table(rows, ["c", "d"])
    assert levels.where("column = 'c'").agg(F.max("place")).first()[0] == 9000  # and `unknown` at 0
    design = splits.sparse_design(rows, levels, ["c", "d"], ["n"], key="id")
    one = design.where("id = 9001").first()
    order = sorted(f"l{i}" for i in range(9000))
    assert one["size"] == 9001 + 2 + 1 and one["indices"] == [1 + order.index("l1"), 9001 + 1, 9003] and one["values"] == [1.0, 1.0, 1.0]
    assert design.where("id = 10").first()["indices"] == [1 + order.index("l10"), 9001] and design.count() == 20_000


def test_join_checks_both_sides(spark):
    left = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, j int, x string")
    right = spark.createDataFrame([(1, 1, "c"), (3, 1, "d")], "k int, j int, y string")
    assert [tuple(r) for r in preferences.join_one_to_one(left, right, ["k", "j"]).collect()] == [(1, 1, "a", "c")]
    for a, b, side in ((left.unionByName(left.limit(1)), right, "left"), (left, right.unionByName(right), "right")):
        with pytest.raises(Exception, match=f"on the {side} side"):
            preferences.join_one_to_one(a, b, ["k", "j"]).collect()


def test_report_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    plus = F.udf(lambda x: seen.add(1) or x, "long")
    writers.write_report(spark.range(3).select(plus("id").alias("id")), f"file://{tmp_path}", "r")
    assert seen.value == 3 and spark.read.json(f"file://{tmp_path}/r.json").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/r.csv").count() == 3


def test_fits_that_do_not_converge_are_marked(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(p, f"{p}_{i}", int(rng.random() < 0.5), *rng.normal(size=4).tolist()) for p in (1, 2) for i in range(20)] + [(3, "x", 1, 0.0, 0.0, 0.0, 0.0)],
                                  "prompt_id int, pair_id string, y int, dz_alpha double, dz_beta double, dz_gamma double, dz_delta double")
    done = {r.prompt_id: (r.converged, r.source) for r in targets.prompt_targets(pairs, min_pairs=1).collect()}
    assert done[1][0] is done[2][0] is True and done[3] == (None, "uniform")
    plain = targets.prompt_logits
    monkeypatch.setattr(targets, "prompt_logits", lambda base, strength: plain(base, strength, most_steps=1))
    assert {(r.converged, r.source) for r in targets.prompt_targets(pairs.where("prompt_id < 3"), min_pairs=1).collect()} == {(False, "uniform")}


def test_quasi_newton_steps_and_the_gradient_of_the_ranker(spark):
    scales = np.array([1.0, 30.0, 0.1])
    found = training.minimize(lambda x: (float((scales * (x - 2) ** 2).sum()), 2 * scales * (x - 2)), np.zeros(3), 50, 1e-9)
    assert np.allclose(found, 2.0, atol=1e-6)
    rng = np.random.default_rng(2)
    x, y, hidden = rng.normal(size=(40, 2)), rng.integers(0, 2, 40).astype(float), 3
    theta = rng.normal(size=hidden * 4)

    def loss(t):
        w, c, v = t[:6].reshape(3, 2), t[6:9], t[9:]
        m = (np.tanh(x @ w.T + c) - np.tanh(c - x @ w.T)) @ v
        return np.logaddexp(0, np.where(y > 0.5, -m, m)).sum()

    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"y": y, "a": x[:, 0], "b": x[:, 1]})
    sums = next(training._loss_sums(hidden, 2, theta)(iter([batch]))).column(1).to_numpy()
    assert sums[0] == 40 and sums[1] == pytest.approx(loss(theta))
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        assert sums[2 + i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, abs=1e-4)


def test_short_groups_are_ranked_without_buckets(spark, monkeypatch):
    """Only groups of more than GROUP_ROWS rows go through buckets; all are ranked alike, null keys and values too."""
    rows = [(g, i, None if i % 7 == 0 else float(i % 5)) for g, n in ((1, 40), (2, 9), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, x double")
    want = sorted(map(str, scale.ranked_totals(df, ["g"], "x", ["i"], {"rank": F.lit(1)}).select("g", "i", "rank").collect()))
    seen = []
    buckets = scale.ranked_totals
    monkeypatch.setattr(scale, "ranked_totals", lambda rows, *a, **k: seen.append(rows) or buckets(rows, *a, **k))
    assert sorted(map(str, scale.value_rank(df, ["g"], "x", ["i"], "rank").select("g", "i", "rank").collect())) == want and not seen
    monkeypatch.setattr(scale, "GROUP_ROWS", 10)
    assert sorted(map(str, scale.value_rank(df, ["g"], "x", ["i"], "rank").select("g", "i", "rank").collect())) == want
    assert {r["g"] for r in seen[0].collect()} == {1, None}


def test_pairs_are_fitted_from_stored_blocks(spark, monkeypatch):
    """A step reads blocks of numbers, not rows; blocks of any size give the same network."""
    rng = np.random.default_rng(12)
    rows = [(int(rng.integers(0, 2)), *(None if rng.random() < 0.1 else float(v) for v in rng.normal(size=2))) for _ in range(300)]
    pairs = spark.createDataFrame(rows, "y int, a double, b double").repartition(3)
    read = []
    monkeypatch.setattr(training, "stored", lambda df, label: read.append(scale.stored(df, label)) or read[-1])
    found = []
    for at in (65_536, 50):
        monkeypatch.setattr(training, "BLOCK_ROWS", at)
        found.append(training.fit_antisymmetric_ranker(pairs, ["a", "b"], hidden=2))
    assert read[0].count() <= 3 and all(r.columns == ["block"] for r in read)
    assert read[0].agg(F.sum(F.length("block"))).first()[0] == 300 * 3 * 8
    gradient = training.antisymmetric_gradient(pairs.na.fill(0.0), found[0], 0.01, ["a", "b"])
    assert gradient.agg(F.max(F.abs("gradient"))).first()[0] < 1e-4
    assert all(np.allclose(found[0][k], found[1][k], atol=1e-3) for k in "wcv")


def test_sums_of_large_margins_stay_finite():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"y": [0.0, 1.0, 1.0], "a": [1e4, -1e4, 0.0]})
    sums = next(training._loss_sums(1, 1, np.array([2.0, 500.0, 3.0]))(iter([batch]))).column(1).to_numpy()
    assert np.isfinite(sums).all() and sums[1] == pytest.approx(2 * np.logaddexp(0.0, 6.0) + np.log(2.0))
