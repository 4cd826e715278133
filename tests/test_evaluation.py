import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tetrarank.operators import evaluation, ranking, reports
from tetrarank.operators import lists as short


def sp(x):
    return np.logaddexp(0, x)


@pytest.fixture(scope="module")
def lists(spark):
    """Three lists of very different length; the longest needs several blocks below."""
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"prompt_id": np.repeat([1, 2, 3, 4], [90, 30, 1, 5]), "item_id": np.arange(126)})
    frame["gt_score"] = np.round(rng.uniform(0, 1, 126), 1)
    frame["score"] = np.round(rng.normal(size=126), 2)
    frame.loc[frame.prompt_id == 4, "gt_score"] = 0.0
    frame["method"] = "m"
    return frame, spark.createDataFrame(frame).checkpoint()


def test_list_metrics(lists):
    frame, df = lists
    got = ranking.list_metrics(df, k=10).toPandas().set_index("prompt_id")
    for p, rows in frame.groupby("prompt_id"):
        order = rows.sort_values(["score", "item_id"], ascending=[False, True]).gt_score.to_numpy()
        ideal = np.sort(rows.gt_score)[::-1]

        def dcg(r):
            r = r[:10]
            return ((2 ** r - 1) / np.log2(np.arange(2, len(r) + 2))).sum()

        relevant = order >= 0.9
        assert got.ndcg[p] == pytest.approx(dcg(order) / dcg(ideal) if dcg(ideal) else 0.0)
        assert got.mrr[p] == pytest.approx(1 / (np.argmax(relevant) + 1) if relevant.any() else 0.0)
        assert got.hit[p] == pytest.approx(relevant[:10].sum() / relevant.sum() if relevant.any() else 0.0)
        assert 0 <= got.ndcg[p] <= 1


def test_listwise_losses(lists):
    frame, df = lists
    by = ["prompt_id"]
    mle = {r["prompt_id"]: r["listmle"] for r in ranking.listmle(df, by).collect()}
    net = {r["prompt_id"]: r["listnet"] for r in ranking.listnet(df, by, temperature=2.0).collect()}
    pair = {r["prompt_id"]: r for r in ranking.ranknet(df, by, block_rows=20).collect()}
    soft = {r["prompt_id"]: r["approx_ndcg"] for r in ranking.approx_ndcg(df, by, temperature=0.5, block_rows=20).collect()}
    cut = {r["prompt_id"]: r["approx_ndcg"] for r in ranking.approx_ndcg(df, by, k=5, block_rows=20).collect()}
    for p, rows in frame.groupby("prompt_id"):
        rows = rows.sort_values(["gt_score", "item_id"], ascending=[False, True])
        s, g, n = rows.score.to_numpy(), rows.gt_score.to_numpy(), len(rows)
        tails = np.cumsum(np.exp(s - s.max())[::-1])[::-1]
        assert mle[p] == pytest.approx(-(s - s.max() - np.log(tails + 1e-10)).sum())
        ps, pg = (np.exp(x / 2) / np.exp(x / 2).sum() for x in (s, g))
        assert net[p] == pytest.approx(-(pg * np.log(ps + 1e-10)).sum())
        better = g[:, None] > g[None, :]
        loss = sp(-(s[:, None] - s[None, :]))[better]
        assert pair[p]["pairs"] == better.sum()
        assert pair[p]["ranknet"] == pytest.approx(loss.mean() if len(loss) else 0.0)
        for t, k, got in ((0.5, None, soft), (1.0, 5, cut)):
            ranks = (1 / (1 + np.exp(-(s[:, None] - s[None, :]) / t))).sum(1)
            gains = g / np.log2(n + 2 - ranks)
            if k:
                gains = gains[np.lexsort((rows.item_id, np.round(ranks, 9)))[:k]]
            ideal = (g[:k] / np.log2(np.arange(2, len(g[:k]) + 2))).sum()
            assert got[p] == pytest.approx(1 - gains.sum() / (ideal + 1e-10))


def test_agreement_slices_keep_null_groups(spark):
    rows = spark.createDataFrame([(1, 0.05, "a", "easy"), (1, 0.2, "a", "hard"), (0, 0.2, None, "hard"), (0, -0.3, "a", None)],
                                 "y int, margin double, category string, difficulty string")
    report = evaluation.agreement_report(rows).toPandas()
    top = report[report.slice == "overall"].iloc[0]
    assert (top.n, top.correct, top.incorrect, top.ties) == (4, 2, 1, 1)
    assert top.acc_no_ties == pytest.approx(2 / 3) and top.acc_ties_half == pytest.approx(2.5 / 4)
    assert report[(report.slice == "category") & report.slice_value.isna()].n.tolist() == [1]
    dropped = evaluation.agreement_report(rows, drop_null_slices=True).toPandas()
    assert not dropped[(dropped.slice != "overall")].slice_value.isna().any()
    strict = evaluation.strict_metrics(rows).first()
    assert strict["agree_no_ties"] == 0.75 and strict["agree_ties_half"] == pytest.approx(2.5 / 4)


def test_auc_with_one_class_is_null(spark):
    rows = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.5), ("b", 1, 0.3), ("b", 0, 0.3)], "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in evaluation.auc(rows, ["g"], "s", "y").collect()}
    assert got == {"a": None, "b": 0.5}


def test_gating_sweep(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.9, 0.1, 0.0, 0.0), (0, 0.5, 0.4, 0.6, 0.0, 0.0)],
                                 "y int, margin double, w_alpha double, w_beta double, w_gamma double, w_delta double")
    sweep = {r["threshold"]: r for r in evaluation.gating_sweep(rows, [0.0, 0.5, 0.75], ["w_alpha", "w_beta", "w_gamma", "w_delta"]).collect()}
    assert [sweep[t]["gated"] for t in (0.0, 0.5, 0.75)] == [0, 2, 1]
    assert sweep[0.0]["gated_agree"] is None and sweep[0.75]["gated_agree"] == 1.0 and sweep[0.75]["other_agree"] == 0.0
    assert sweep[0.5]["dominant_beta"] == 1


def test_class_metrics_and_temperature(spark):
    rows = spark.createDataFrame([(0, 0, [2.0, 1.0]), (0, 1, [1.0, 2.0]), (1, 1, [0.0, 3.0]), (2, 1, [0.0, 1.0])], "t int, p int, z array<double>")
    per = {r["label"]: r for r in reports.class_metrics(reports.confusion(rows, "t", "p")).collect()}
    assert per[1]["precision"] == pytest.approx(1 / 3) and per[1]["recall"] == 1.0 and per[2]["f1"] == 0.0
    total = reports.overall_class_metrics(reports.class_metrics(reports.confusion(rows, "t", "p"))).first()
    assert total["accuracy"] == 0.5 and total["f1_weighted"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    grid = reports.temperature_grid(rows.where("t < 2"), "z", F.col("t")).toPandas()
    assert len(grid) == 44 and grid.temperature.min() == 0.7 and grid.temperature.max() == pytest.approx(5.0)
    z, t = np.array([[2.0, 1], [1, 2], [0, 3]]), np.array([0, 0, 1])

    def nll(temp):
        e = np.exp(z / temp)
        return -np.log(e[np.arange(3), t] / e.sum(1) + 1e-12).mean()

    assert np.allclose(grid.sort_values("temperature").nll, [nll(x) for x in np.linspace(0.7, 5, 44)])


def test_comparison_tables(spark):
    report = spark.createDataFrame([("a", "overall", None, 0.5), ("b", "overall", None, 0.6), ("a", "category", "x", 0.4), ("a", "category", "y", 0.6),
                                    ("b", "category", "x", 0.6), ("b", "category", "y", 0.6)], "model string, slice string, slice_value string, acc_ties_half double")
    assert [r["model"] for r in reports.overall_ranking(report).collect()] == ["b", "a"]
    best = {(r["slice"], r["slice_value"]): r["model"] for r in reports.best_models(report).collect()}
    assert best == {("overall", None): "b", ("category", "x"): "b", ("category", "y"): "a"}
    gain = reports.relative_improvement(report.where("slice = 'overall'"), "b", ["acc_ties_half"], "model").first()
    assert gain["acc_ties_half"] == pytest.approx(20.0)
    assert {r["model"]: r["variance"] for r in reports.robustness(report).collect()}["b"] == pytest.approx(0.0)


def test_diversity(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 4, 5)], "prompt_id long, movieA long, movieB long")
    rows = {r["prompt_id"]: r for r in reports.pair_diversity(pairs, expected=4).collect()}
    assert rows[1]["unique_items"] == 3 and rows[1]["repeated_items"] == 1 and rows[1]["max_appearances"] == 2 and rows[1]["diversity"] == 75.0


def test_short_and_long_lists_have_the_same_losses(spark, monkeypatch):
    """Short lists are computed together where they lie; keys may be null or repeat, scores and relevance may be missing."""
    rng = np.random.default_rng(9)
    rows = [(None if p == 3 else p, f"k{p % 2}", None if rng.random() < 0.02 else f"i{i}", None if p in (4, 5) and rng.random() < 0.2 else float(rng.normal()),
             None if rng.random() < 0.05 else float(rng.integers(0, 5))) for p in range(40) for i in range(int(rng.integers(1, 30)))]
    rows += rows[:25] + [(50, "k0", "a", None, None), (51, "k0", "a", 1.0, None), (52, "k0", "a", None, 1.0)]
    df = spark.createDataFrame(rows, "p long, q string, item_id string, score double, gt_score double")
    losses = {"listmle": lambda: ranking.listmle(df, ["p", "q"]), "ranknet": lambda: ranking.ranknet(df, ["p", "q"]), "ndcg": lambda: ranking.approx_ndcg(df, ["p", "q"], temperature=0.5)}
    monkeypatch.setattr(short, "GATHERED", 100)

    def found():
        return {name: sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in f().collect()), key=str) for name, f in losses.items()}

    for f in losses.values():
        assert "CoGroups" not in f()._jdf.queryExecution().optimizedPlan().toString()  # no task per list
    got = found()
    monkeypatch.setattr(ranking, "_by_length", lambda rows, by, most, short_lists, long_lists: long_lists(rows))
    want = found()
    assert got == want and len(got["listmle"]) == 43 and len(got["ranknet"]) == 42
    monkeypatch.undo()
    monkeypatch.setattr(ranking, "LIST_ROWS", 12)
    assert found()["listmle"] == want["listmle"]
