"""Evaluation, ranking metric, loss, statistics and comparison queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS, EMOTIONS, EXPERTS
from tetrarank.functions import distributions as dx
from tetrarank.functions import numeric as nx
from tetrarank.functions import vectors as vx
from tetrarank.operators import evaluation, ranking, reports, scale, scoring, splits
from tetrarank.workloads import views as v
from tetrarank.workloads.retrieval import rounded
from tetrarank.workloads.views import hashed, r, uniform, with_ctes

W = [f"w_{e}" for e in EXPERTS]
AGREE = "(CASE WHEN abs({m}) <= 0.05 THEN 0 WHEN {m} > 0 THEN 1 ELSE -1 END) * (CASE WHEN y > 0.5 THEN 1 ELSE -1 END)"
COUNTS = f"""count(*) AS n, sum((agree = 1)::INT)::BIGINT AS correct, sum((agree = -1)::INT)::BIGINT AS incorrect, sum((agree = 0)::INT)::BIGINT AS ties,
 {r('sum((agree = 1)::INT) / greatest(sum((agree <> 0)::INT), 1)')} AS acc_no_ties, {r('(sum((agree = 1)::INT) + 0.5::DOUBLE * sum((agree = 0)::INT)) / count(*)')} AS acc_ties_half,
 {r('sum((agree = 0)::INT) / count(*)')} AS tie_rate"""
ACCS = ("acc_no_ties", "acc_ties_half", "tie_rate")
SLICED = "SELECT {pre} CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS slice, coalesce(category, difficulty) AS slice_value, {agg} FROM {src} GROUP BY GROUPING SETS ({sets})"


def agreement_report(spark, sf):
    return rounded(evaluation.agreement_report(v.margin_pairs(spark, sf)), *ACCS)


def test_split_agreement(spark, sf):
    rows = splits.split_by_group(v.margin_pairs(spark, sf), ["prompt_id"], ["category"]).where("split = 'test'")
    return rounded(evaluation.agreement_report(rows, "dz_alpha"), *ACCS)


def strict_metrics(spark, sf):
    out = evaluation.strict_metrics(v.margin_pairs(spark, sf), by=["category"])
    return rounded(out, "agree_no_ties", "agree_ties_half", "mean_abs_score", "std_score")


_STRICT = with_ctes("margin_pairs") + f"""SELECT category, count(*) AS n_pairs, {r('avg((sign(margin) = (CASE WHEN y > 0.5 THEN 1 ELSE -1 END))::INT)')} AS agree_no_ties,
 {r('avg(CASE WHEN abs(margin) <= 0.05 THEN 0.5::DOUBLE ELSE (sign(margin) = (CASE WHEN y > 0.5 THEN 1 ELSE -1 END))::INT END)')} AS agree_ties_half,
 {r('avg(abs(margin))')} AS mean_abs_score, {r('stddev_pop(margin)')} AS std_score FROM margin_pairs GROUP BY 1"""


def _all_models(spark, sf):
    p = v.weighted_pairs(spark, sf)
    uniform_margin = (F.col("dz_alpha") + F.col("dz_beta") + F.col("dz_gamma") + F.col("dz_delta")) / 4.0
    return evaluation.unpivot_margins(
        p.withColumn("uniform", uniform_margin), {**{e: f"dz_{e}" for e in EXPERTS}, "uniform": "uniform", "mixture": "margin"},
        ["pair_id", "y", "category", "difficulty"])


def _all_reports(spark, sf):
    return evaluation.agreement_report(_all_models(spark, sf), by=["model"])


def model_report(spark, sf):
    """Agreement of six models, overall and per slice, in one pass."""
    return rounded(_all_reports(spark, sf), *ACCS)


_MODELS = {**{e: f"dz_{e}" for e in EXPERTS}, "uniform": "(dz_alpha + dz_beta + dz_gamma + dz_delta) / 4.0::DOUBLE", "mixture": "margin"}
_LONG = with_ctes("weighted_pairs") + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, pair_id, y, category, difficulty, {e} AS margin FROM weighted_pairs" for m, e in _MODELS.items()) \
    + f"), marked AS (SELECT *, {AGREE.format(m='margin')} AS agree FROM long), report AS (" \
    + SLICED.format(pre="model,", agg=COUNTS, src="marked", sets="(model), (model, category), (model, difficulty)") + ")\n"


def model_ranking(spark, sf):
    out = reports.overall_ranking(_all_reports(spark, sf)).select("model", "acc_ties_half", "n")
    return rounded(out, "acc_ties_half")


def model_by_category(spark, sf):
    return rounded(reports.slice_pivot(_all_reports(spark, sf), "category", ["A", "N", "R"]), "A", "N", "R")


def model_by_difficulty(spark, sf):
    levels = ["easy", "medium", "hard"]
    return rounded(reports.slice_pivot(_all_reports(spark, sf), "difficulty", levels), *levels)


def best_models(spark, sf):
    return rounded(reports.best_models(_all_reports(spark, sf)), "acc_ties_half")


def model_robustness(spark, sf):
    return rounded(reports.robustness(_all_reports(spark, sf)), "variance", "mean_score", digits=9)


def model_ablation(spark, sf):
    return rounded(reports.ablation(_all_reports(spark, sf), EXPERTS), "score")


def method_improvement(spark, sf):
    overall = _all_reports(spark, sf).where("slice = 'overall'")
    out = reports.relative_improvement(overall, "mixture", ["acc_no_ties", "acc_ties_half"], "model")
    return rounded(out, "acc_no_ties", "acc_ties_half", digits=4)


def ranker_report(spark, sf):
    out = evaluation.ranker_report(v.margin_pairs(spark, sf))
    return rounded(out, *ACCS, "auc")


def auc_by_category(spark, sf):
    out = evaluation.auc(v.pairs(spark, sf), ["category"], "dz_alpha", "y")
    return rounded(out, "auc")


def _auc_sql(source, score, by):
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}" if by else ""
    lead = f"{keys}, " if by else ""
    return f"""SELECT {lead}sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auc FROM (
  SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0::DOUBLE AS rk FROM {source}) a {f'GROUP BY {keys}' if by else ''}"""


_RANKER = with_ctes("margin_pairs") + f""", marked AS (SELECT *, {AGREE.format(m='margin')} AS agree FROM margin_pairs),
report AS ({SLICED.format(pre='', agg=COUNTS, src='marked', sets='(), (category), (difficulty)')}),
stacked AS (SELECT 'overall' AS slice, NULL AS slice_value, margin, y FROM margin_pairs UNION ALL SELECT 'category', category, margin, y FROM margin_pairs UNION ALL SELECT 'difficulty', difficulty, margin, y FROM margin_pairs),
areas AS ({_auc_sql('stacked', 'margin', ['slice', 'slice_value'])})
SELECT r.*, {r('a.auc')} AS auc FROM report r JOIN areas a ON a.slice = r.slice AND a.slice_value IS NOT DISTINCT FROM r.slice_value"""


def fused_pair_metrics(spark, sf):
    return rounded(evaluation.fused_pair_metrics(v.weighted_pairs(spark, sf)), "accuracy", "logloss", "auc")


_FUSEDM = with_ctes("weighted_pairs") + f""", p AS (SELECT *, least(greatest(1 / (1 + exp(-margin)), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS pr FROM weighted_pairs)
SELECT count(*) AS n, {r('avg(((margin > 0) = (y > 0.5))::INT)')} AS accuracy, {r('avg(-CASE WHEN y > 0.5 THEN ln(pr) ELSE ln(1 - pr) END)')} AS logloss,
 (SELECT {r('auc')} FROM ({_auc_sql('weighted_pairs', 'margin', [])}) b) AS auc FROM p"""

THRESHOLDS = [0.0, 0.5, 0.65, 0.75, 0.9]


def gating_sweep(spark, sf):
    out = evaluation.gating_sweep(v.weighted_pairs(spark, sf), THRESHOLDS, W)
    return rounded(out, *ACCS, "gating_rate", "gated_agree", "other_agree")


def best_gating_threshold(spark, sf):
    out = evaluation.best_threshold(evaluation.gating_sweep(v.weighted_pairs(spark, sf), THRESHOLDS, W))
    return out.select("threshold", F.round("acc_ties_half", 6).alias("acc_ties_half"))


_DOM = "CASE " + " ".join(f"WHEN w_{e} = top THEN '{e}'" for e in EXPERTS) + " END"
_SWEEP = with_ctes("weighted_pairs") + f""", s AS (SELECT *, threshold > 0 AND top >= threshold AS g, {_DOM} AS dom FROM (
  SELECT *, greatest(w_alpha, w_beta, w_gamma, w_delta) AS top, {AGREE.format(m='margin')} AS agree FROM weighted_pairs) a, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold) t),
sweep AS (SELECT threshold, {COUNTS}, sum(g::INT)::BIGINT AS gated, {r('avg(g::INT)')} AS gating_rate,
 {r('avg(CASE agree WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 0 END) FILTER (g)')} AS gated_agree,
 {r('avg(CASE agree WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 0 END) FILTER (NOT g)')} AS other_agree,
 {', '.join(f"sum((g AND dom = '{e}')::INT)::BIGINT AS dominant_{e}" for e in EXPERTS)} FROM s GROUP BY 1)"""


def weight_report(spark, sf):
    out = evaluation.weight_report(v.weighted_pairs(spark, sf), W, ["category"])
    return rounded(out, "mean_weight", "std_weight", "min_weight", "max_weight")


_WREP = with_ctes("weighted_pairs") + f", t AS (SELECT *, {_DOM} AS dom FROM (SELECT *, greatest(w_alpha, w_beta, w_gamma, w_delta) AS top FROM weighted_pairs) a) " + " UNION ALL ".join(
    f"SELECT category, '{e}' AS expert, {r(f'avg(w_{e})')} AS mean_weight, {r(f'stddev_pop(w_{e})')} AS std_weight, {r(f'min(w_{e})')} AS min_weight, {r(f'max(w_{e})')} AS max_weight, sum((dom = '{e}')::INT)::BIGINT AS selected FROM t GROUP BY 1"
    for e in EXPERTS)


def weight_distances(spark, sf):
    """Customer mixtures against the uniform mixture blended with them, per market segment."""
    w = v.prompt_weights(spark, sf).join(v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("prompt_id"), F.col("c_mktsegment").alias("segment")), "prompt_id")
    w = w.select("*", *[(F.col(f"w_{e}") * 0.5 + 0.125).alias(f"p_{e}") for e in EXPERTS])
    out = evaluation.weight_distances(w, W, [f"p_{e}" for e in EXPERTS], ["segment"])
    return rounded(out, "kl", "l1", "cosine")


_CL = "least(greatest({}, 1e-8::DOUBLE), 1.0::DOUBLE)"
_KL = " + ".join(f"{_CL.format(f'w_{e}')} * (ln({_CL.format(f'w_{e}')}) - ln({_CL.format(f'p_{e}')}))" for e in EXPERTS)
_WDIST = with_ctes("prompt_weights") + f""", w AS (SELECT *, c_mktsegment AS segment, {', '.join(f'w_{e} * 0.5::DOUBLE + 0.125::DOUBLE AS p_{e}' for e in EXPERTS)} FROM prompt_weights JOIN customer ON c_custkey = prompt_id)
SELECT CASE WHEN grouping(segment) = 0 THEN 'segment' ELSE 'overall' END AS slice, segment AS slice_value, count(*) AS n, {r(f'avg({_KL})')} AS kl,
 {r('avg(' + ' + '.join(f'abs(w_{e} - p_{e})' for e in EXPERTS) + ')')} AS l1,
 {r('avg((' + ' + '.join(f'w_{e} * p_{e}' for e in EXPERTS) + ') / (sqrt(' + ' + '.join(f'w_{e} * w_{e}' for e in EXPERTS) + ') * sqrt(' + ' + '.join(f'p_{e} * p_{e}' for e in EXPERTS) + ') + 1e-9::DOUBLE))')} AS cosine
 FROM w GROUP BY GROUPING SETS ((), (segment))"""


def pair_loss_report(spark, sf):
    out = evaluation.loss_report(v.weighted_pairs(spark, sf), "margin", "y", W, ["category"])
    return rounded(out, "btl", "focal", "margin_push", "entropy_hinge", "low_entropy_penalty", "gating_penalty")


_SP = "(ln(1 + exp(-abs({x}))) + greatest({x}, 0))"
_BTL = f"(CASE WHEN y > 0.5 THEN {_SP.format(x='-margin')} ELSE {_SP.format(x='margin')} END)"
_PT = "least(greatest(CASE WHEN y > 0.5 THEN 1 / (1 + exp(-margin)) ELSE 1 - 1 / (1 + exp(-margin)) END, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
_NAT = "-(" + " + ".join(f"greatest(w_{e}, 1e-8::DOUBLE) * ln(greatest(w_{e}, 1e-8::DOUBLE))" for e in EXPERTS) + ")"
_PLAIN = "-(" + " + ".join(f"w_{e} * ln(w_{e} + 1e-10::DOUBLE)" for e in EXPERTS) + ")"
_FLOOR = "-(" + " + ".join(f"w_{e} * ln(greatest(w_{e}, 1e-8::DOUBLE))" for e in EXPERTS) + ")"
_LOSS = with_ctes("weighted_pairs") + f"""SELECT category, count(*) AS n, {r(f'avg({_BTL})')} AS btl, {r(f'avg({_BTL} * pow(1 - {_PT}, 2))')} AS focal,
 {r('avg(greatest(0.5::DOUBLE - abs(margin), 0))')} AS margin_push, {r(f'greatest(avg({_NAT}) - 1.0::DOUBLE, 0)')} AS entropy_hinge,
 {r(f'avg(greatest(0.6::DOUBLE - {_PLAIN}, 0))')} AS low_entropy_penalty,
 {r(f'0.1::DOUBLE * avg(1 / (1 + exp(-10 * (greatest(w_alpha, w_beta, w_gamma, w_delta) - 0.75::DOUBLE))) * {_FLOOR} / ln(4.0::DOUBLE))')} AS gating_penalty FROM weighted_pairs GROUP BY 1"""


# --- errors ---------------------------------------------------------------------------------------------

def outcome_counts(spark, sf):
    out = evaluation.outcome_labels(v.pairs(spark, sf), None)
    return out.groupBy("outcome", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 6).alias("mean_prediction"))


def expert_disagreements(spark, sf):
    out = evaluation.expert_disagreements(v.pairs(spark, sf))
    return out.groupBy("num_positive", "num_negative", "num_zero").agg(F.count(F.lit(1)).alias("n"))


def mixture_only_failures(spark, sf):
    out = evaluation.mixture_only_failures(v.margin_pairs(spark, sf), "margin")
    return out.select("pair_id", "moe_agreement", *[f"{c}_agreement" for c in DZ_COLUMNS])


def failure_patterns(spark, sf):
    failed = evaluation.outcome_labels(v.margin_pairs(spark, sf)).where("outcome = 'incorrect'")
    return reports.distinct_counts(failed, ["category", "difficulty"])


def case_studies(spark, sf):
    failed = evaluation.outcome_labels(v.margin_pairs(spark, sf)).where("outcome = 'incorrect'")
    return evaluation.case_studies(failed).select("category", "case_no", "pair_id", "agreement")


def slice_shares(spark, sf):
    p = v.margin_pairs(spark, sf)
    out = reports.shares(p, ["category", "difficulty"], nx.agreement(F.col("margin"), F.col("y")) == -1)
    return rounded(out, "failure_rate", "percent", digits=4)


_MARK = with_ctes("margin_pairs") + f", m AS (SELECT *, {AGREE.format(m='margin')} AS agree FROM margin_pairs) "


# --- vector margins ----------------------------------------------------------------------------------------

def embedding_margin_report(spark, sf):
    """Pairs judged by cosine(prompt, A) - cosine(prompt, B) where all three vectors exist, else a tie."""
    vectors = v.vectors(spark, sf).select("item_id", "vector")
    p = v.pairs(spark, sf)
    joined = p
    for key, name in (("prompt_id", "q"), ("movieA", "a"), ("movieB", "b")):
        joined = joined.join(vectors.select(F.col("item_id").alias(f"k{name}"), F.col("vector").alias(name)),
                             F.col(key) == F.col(f"k{name}"), "left")
    margin = F.coalesce(vx.cosine(F.col("q"), F.col("a")) - vx.cosine(F.col("q"), F.col("b")), F.lit(0.0))
    return rounded(evaluation.agreement_report(joined.withColumn("margin", margin)), *ACCS)


_C64 = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))) + 1e-12::DOUBLE)"
_EMB = with_ctes("pairs", "vectors") + f""", j AS (SELECT p.*, coalesce({_C64.format(a='q.vector', b='a.vector')} - {_C64.format(a='q.vector', b='b.vector')}, 0) AS margin
  FROM pairs p LEFT JOIN vectors q ON q.item_id = prompt_id LEFT JOIN vectors a ON a.item_id = "movieA" LEFT JOIN vectors b ON b.item_id = "movieB"),
marked AS (SELECT *, {AGREE.format(m='margin')} AS agree FROM j) """ + SLICED.format(pre="", agg=COUNTS, src="marked", sets="(), (category), (difficulty)")


def external_score_report(spark, sf):
    """Scores of an external reranker (here part prices) looked up for both sides of a pair; missing is 0."""
    s = v.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_retailprice") / 997.0).alias("s"))
    p = v.pairs(spark, sf)
    a = p.join(s.select(F.col("item").alias("movieA"), F.col("s").alias("sa")), "movieA", "left")
    b = a.join(s.select(F.col("item").alias("movieB"), F.col("s").alias("sb")), "movieB", "left")
    rows = b.withColumn("margin", F.coalesce(F.col("sa"), F.lit(0.0)) - F.coalesce(F.col("sb"), F.lit(0.0)))
    return rounded(evaluation.agreement_report(rows, drop_null_slices=True), *ACCS)


_EXT = with_ctes("pairs") + f""", j AS (SELECT p.*, coalesce(a.p_retailprice / 997.0::DOUBLE, 0) - coalesce(b.p_retailprice / 997.0::DOUBLE, 0) AS margin
  FROM pairs p LEFT JOIN part a ON a.p_partkey = "movieA" LEFT JOIN part b ON b.p_partkey = "movieB"),
marked AS (SELECT *, {AGREE.format(m='margin')} AS agree FROM j) """ + SLICED.format(pre="", agg=COUNTS, src="marked", sets="(), (category), (difficulty)")


# --- ranking metrics -----------------------------------------------------------------------------------------

def _methods(spark, sf, trials=0):
    rows = v.ranking_with_weights(spark, sf)
    return ranking.unpivot_methods(rows, ranking.mixture_methods(weights="mix_", random_trials=trials), ["prompt_id", "item_id", "gt_score"])


def list_metrics(spark, sf):
    """nDCG@10, reciprocal rank and recall of four experts, the uniform and the per-prompt mixture, per list."""
    return rounded(ranking.list_metrics(_methods(spark, sf)), "ndcg", "mrr", "hit")


def method_report(spark, sf):
    out = ranking.method_report(ranking.list_metrics(_methods(spark, sf)))
    return rounded(out, *[c for m in ("ndcg", "mrr", "hit") for c in (m, f"{m}_std")])


def random_baseline(spark, sf):
    out = ranking.random_baseline(ranking.list_metrics(_methods(spark, sf, 3)))
    return rounded(out, *[c for m in ("ndcg", "mrr", "hit") for c in (m, f"{m}_std")])


def segment_report(spark, sf):
    """List metrics per method and market segment, with the mean mixture weight of each expert."""
    metrics = ranking.list_metrics(_methods(spark, sf))
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt_id"), F.col("c_mktsegment").alias("segment"))
    joined = metrics.join(c, "prompt_id").join(v.prompt_weights(spark, sf), "prompt_id")
    out = joined.groupBy("method", "segment").agg(F.count(F.lit(1)).alias("n_prompts"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"),
                                                  *[F.avg(w).alias(w) for w in W], F.corr("ndcg", "w_alpha").alias("corr_alpha"))
    return rounded(out, "ndcg", "mrr", *W, "corr_alpha")


def _list_sql(trials=0):
    exprs = {**{e: f"z_{e}" for e in EXPERTS}, "uniform": "(z_alpha + z_beta + z_gamma + z_delta) / 4.0::DOUBLE",
             "oracle": "mix_alpha * z_alpha + mix_beta * z_beta + mix_gamma * z_gamma + mix_delta * z_delta"}
    for t in range(trials):
        exprs[f"random_{t}"] = uniform(str(t), "prompt_id", "item_id")
    return with_ctes("weighted_ranking") + ", long AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS method, prompt_id, item_id, gt_score, round({e}, 9) AS s FROM weighted_ranking" for m, e in exprs.items()) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY method, prompt_id ORDER BY s DESC, item_id) AS pr, row_number() OVER (PARTITION BY method, prompt_id ORDER BY gt_score DESC, item_id) AS gr FROM long),
metrics AS (SELECT method, prompt_id, count(*) AS n_items,
  CASE WHEN sum((pow(2, gt_score) - 1) / log2(gr + 1)) FILTER (gr <= 10) = 0 THEN 0 ELSE sum((pow(2, gt_score) - 1) / log2(pr + 1)) FILTER (pr <= 10) / sum((pow(2, gt_score) - 1) / log2(gr + 1)) FILTER (gr <= 10) END AS ndcg,
  coalesce(1.0::DOUBLE / min(pr) FILTER (gt_score >= 0.9), 0) AS mrr,
  CASE WHEN count(*) FILTER (gt_score >= 0.9) = 0 THEN 0 ELSE count(*) FILTER (gt_score >= 0.9 AND pr <= 10) / count(*) FILTER (gt_score >= 0.9) END AS hit FROM ranked GROUP BY 1, 2)
"""


_MEANS = ", ".join(f"{r(f'avg({m})')} AS {m}, {r(f'stddev_pop({m})')} AS {m}_std" for m in ("ndcg", "mrr", "hit"))


def list_losses(spark, sf):
    """ListMLE, ListNet and RankNet losses and approximate nDCG per list, for the per-prompt mixture."""
    rows = v.ranking_with_weights(spark, sf)
    score = nx.weighted_margin([F.col(f"mix_{e}") for e in EXPERTS], [F.col(f"z_{e}") for e in EXPERTS])
    rows = scale.stored(rows.select("prompt_id", "item_id", "gt_score", score.alias("score")), "lists")
    scale.drop_unused(spark)
    by = ["prompt_id"]
    out = ranking.listmle(rows, by).join(ranking.listnet(rows, by), by).join(ranking.ranknet(rows, by), by).join(
        ranking.approx_ndcg(rows, by, temperature=0.5), by)
    scale.drop_unused(spark)
    return rounded(out, "listmle", "listnet", "ranknet", "approx_ndcg", digits=5)


_LISTLOSS = with_ctes("weighted_ranking") + f""", l AS (SELECT prompt_id, item_id, gt_score, mix_alpha * z_alpha + mix_beta * z_beta + mix_gamma * z_gamma + mix_delta * z_delta AS s FROM weighted_ranking),
d AS (SELECT *, s - max(s) OVER p AS ds, exp(s - max(s) OVER p) AS es, exp(gt_score - max(gt_score) OVER p) AS eg, row_number() OVER (PARTITION BY prompt_id ORDER BY gt_score DESC, item_id) AS gr, count(*) OVER p AS n FROM l WINDOW p AS (PARTITION BY prompt_id)),
t AS (SELECT *, sum(es) OVER (PARTITION BY prompt_id ORDER BY gr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, sum(es) OVER (PARTITION BY prompt_id) AS zs, sum(eg) OVER (PARTITION BY prompt_id) AS zg FROM d),
one AS (SELECT prompt_id, -sum(ds - ln(tail + 1e-10::DOUBLE)) AS listmle, -sum(eg / zg * ln(es / zs + 1e-10::DOUBLE)) AS listnet, sum(gt_score / log2(gr + 1)) AS idcg FROM t GROUP BY 1),
two AS (SELECT a.prompt_id, sum(CASE WHEN a.gt_score > b.gt_score THEN {_SP.format(x='(b.s - a.s)')} END) / (count(*) FILTER (a.gt_score > b.gt_score) + 1e-10::DOUBLE) AS ranknet, count(*) FILTER (a.gt_score > b.gt_score) AS pairs
  FROM l a JOIN l b ON a.prompt_id = b.prompt_id GROUP BY 1),
soft AS (SELECT a.prompt_id, a.item_id, a.gt_score, count(*) AS n, sum(1 / (1 + exp(-(a.s - b.s) / 0.5::DOUBLE))) AS sr FROM l a JOIN l b ON a.prompt_id = b.prompt_id GROUP BY 1, 2, 3),
three AS (SELECT prompt_id, sum(gt_score / log2(n + 2 - sr)) AS dcg FROM soft GROUP BY 1)
SELECT prompt_id, {r('listmle', 5)} AS listmle, {r('listnet', 5)} AS listnet, {r('ranknet', 5)} AS ranknet, pairs, {r('1 - dcg / (idcg + 1e-10::DOUBLE)', 5)} AS approx_ndcg FROM one JOIN two USING (prompt_id) JOIN three USING (prompt_id)"""


def expert_score_table(spark, sf):
    """Ground truth rank, z-scores and softmax probabilities of every list entry."""
    order = Window.partitionBy("prompt_id").orderBy(F.desc("gt_score"), "item_id")
    rows = v.ranking(spark, sf).withColumn("rank", F.row_number().over(order))
    z = scoring.zscores(rows, ["prompt_id"], {f"score_{e}": f"z_{e}" for e in EXPERTS}, "pop_strict")
    out = ranking.grouped_softmax(z, ["prompt_id"], {f"z_{e}": f"prob_{e}" for e in EXPERTS})
    names = [f"{p}_{e}" for p in ("z", "prob") for e in EXPERTS]
    return rounded(out.select("prompt_id", "item_id", (F.col("rank") - 1).alias("rank"), *names), *names)


def _strict_z():
    o = "OVER (PARTITION BY prompt_id)"
    return ", ".join(f"CASE WHEN stddev_pop(score_{e}) {o} < 1e-8 THEN 0 ELSE (score_{e} - avg(score_{e}) {o}) / stddev_pop(score_{e}) {o} END AS z_{e}" for e in EXPERTS)


_EXPERT = with_ctes("ranking") + f""", z AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY gt_score DESC, item_id) - 1 AS rank, {_strict_z()} FROM ranking),
e AS (SELECT *, {', '.join(f'exp(z_{e} - max(z_{e}) OVER (PARTITION BY prompt_id)) AS e_{e}' for e in EXPERTS)} FROM z)
SELECT prompt_id, item_id, rank, {', '.join(f'{r(f"z_{e}")} AS z_{e}, {r(f"e_{e} / sum(e_{e}) OVER (PARTITION BY prompt_id)")} AS prob_{e}' for e in EXPERTS)} FROM e"""


def average_ranks(spark, sf):
    p = v.pairs(spark, sf).select("pair_id", "category", "dz_beta")
    return scale.average_ranks(p, ["category"], "dz_beta", "avg_rank").select("pair_id", "avg_rank")


def score_ranks(spark, sf):
    """Rank of every list entry by fused prediction."""
    rows = v.ranking_with_weights(spark, sf)
    score = nx.weighted_margin([F.col(f"mix_{e}") for e in EXPERTS], [F.col(f"z_{e}") for e in EXPERTS])
    rows = rows.select("prompt_id", "item_id", F.round(score, 9).alias("s"))
    return scale.value_rank(rows, ["prompt_id"], "s", ["item_id"], "rank", 1024.0).select("prompt_id", "item_id", "rank")


# --- statistics ---------------------------------------------------------------------------------------------

def pairs_per_prompt(spark, sf):
    return rounded(reports.pairs_per_prompt(v.pairs(spark, sf)), "mean", "std", "median")


def category_difficulty_crosstab(spark, sf):
    return reports.crosstab(v.pairs(spark, sf), "category", "difficulty", ["easy", "medium", "hard"])


def feature_statistics(spark, sf):
    out = reports.feature_statistics(v.pairs(spark, sf))
    return rounded(out, *[c for c in out.columns if c != "feature"])


_FS = with_ctes("pairs") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg(({c} > 0)::INT)')} AS positive_ratio, {r(f'avg(({c} < 0)::INT)')} AS negative_ratio, "
    f"{r(f'avg(({c} = 0)::INT)')} AS zero_ratio, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM pairs" for c in DZ_COLUMNS)


def feature_correlations(spark, sf):
    return rounded(reports.correlations(v.pairs(spark, sf)), "correlation")


_CORR = with_ctes("pairs") + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, {r(f'corr({a}, {b})')} AS correlation FROM pairs"
    for i, a in enumerate(DZ_COLUMNS) for b in DZ_COLUMNS[i + 1:])


def feature_coverage(spark, sf):
    return reports.coverage(v.pairs(spark, sf))


def part_histogram(spark, sf):
    """How often part types and brands occur on either side of a pair."""
    items = v.table(spark, sf, "part").withColumnRenamed("p_partkey", "item_id")
    return reports.manifest_histogram(v.pairs(spark, sf), items, F.array("p_type", "p_brand"))


def pair_diversity(spark, sf):
    return rounded(reports.pair_diversity(v.pairs(spark, sf), expected=8), "diversity")


def diversity_summary(spark, sf):
    return rounded(reports.diversity_summary(reports.pair_diversity(v.pairs(spark, sf), expected=8)), "mean_diversity", "perfect_rate")


_DIV = with_ctes("pairs") + """, d AS (SELECT prompt_id, (sum(u) / 2)::BIGINT AS total_pairs, count(*) AS unique_items, count(*) / 8.0::DOUBLE * 100 AS diversity, sum((u > 1)::INT)::BIGINT AS repeated_items, max(u) AS max_appearances
  FROM (SELECT prompt_id, item, count(*) AS u FROM (SELECT prompt_id, unnest(["movieA", "movieB"]) AS item FROM pairs) a GROUP BY 1, 2) b GROUP BY 1)"""


def _label_rows(spark, sf):
    """Class labels: the label of a vector against the largest of its first ten entries."""
    first = F.slice(vx.as_double(F.col("vector")), 1, 10)
    return v.vectors(spark, sf).select("label", dx.argmax(first).alias("predicted"), vx.as_double(F.slice("vector", 1, 10)).alias("logits"))


def confusion_cells(spark, sf):
    return reports.confusion(_label_rows(spark, sf), "label", "predicted")


def class_metrics(spark, sf):
    return rounded(reports.class_metrics(reports.confusion(_label_rows(spark, sf), "label", "predicted")), "precision", "recall", "f1")


def overall_class_metrics(spark, sf):
    per_class = reports.class_metrics(reports.confusion(_label_rows(spark, sf), "label", "predicted"))
    return rounded(reports.overall_class_metrics(per_class), "accuracy", "f1_micro", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


_CLS = with_ctes("vectors") + """, c AS (SELECT label AS truth, list_position(vector[1:10], list_max(vector[1:10])) - 1 AS predicted FROM vectors),
s AS (SELECT label, sum(support)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM (
  SELECT truth AS label, 1 AS support, 0 AS p, (truth = predicted)::INT AS tp FROM c UNION ALL SELECT predicted AS label, 0, 1, 0 FROM c) a GROUP BY 1),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (predicted + support) ELSE 0 END AS f1 FROM s)"""


def temperature_grid(spark, sf):
    out = reports.temperature_grid(_label_rows(spark, sf), "logits", F.col("label"))
    return rounded(out, "temperature", "nll")


def best_temperature(spark, sf):
    return rounded(reports.best_temperature(reports.temperature_grid(_label_rows(spark, sf), "logits", F.col("label"))), "temperature", "nll")


_TEMP = with_ctes("vectors") + """, g AS (SELECT step, 0.7::DOUBLE + 4.3::DOUBLE * step / 43 AS temperature, avg(-ln(exp(vector[label + 1] / t) / list_sum(list_transform(vector[1:10], lambda x: exp(x / t))) + 1e-12::DOUBLE)) AS nll
  FROM (SELECT *, 0.7::DOUBLE + 4.3::DOUBLE * step / 43 AS t FROM vectors, range(0, 44) s(step)) a GROUP BY 1, 2)"""


def emotion_statistics(spark, sf):
    return rounded(reports.emotion_statistics(v.emotions(spark, sf)), "mean", "std", "max")


QUERIES = {
    "agreement_report": agreement_report, "test_split_agreement": test_split_agreement, "strict_metrics": strict_metrics,
    "model_report": model_report, "model_ranking": model_ranking, "model_by_category": model_by_category,
    "model_by_difficulty": model_by_difficulty, "best_models": best_models, "model_robustness": model_robustness,
    "model_ablation": model_ablation, "method_improvement": method_improvement, "ranker_report": ranker_report,
    "auc_by_category": auc_by_category, "fused_pair_metrics": fused_pair_metrics, "gating_sweep": gating_sweep,
    "best_gating_threshold": best_gating_threshold, "weight_report": weight_report, "weight_distances": weight_distances,
    "pair_loss_report": pair_loss_report, "outcome_counts": outcome_counts, "expert_disagreements": expert_disagreements,
    "mixture_only_failures": mixture_only_failures, "failure_patterns": failure_patterns, "case_studies": case_studies,
    "slice_shares": slice_shares, "embedding_margin_report": embedding_margin_report, "external_score_report": external_score_report,
    "list_metrics": list_metrics, "method_report": method_report, "random_baseline": random_baseline, "segment_report": segment_report,
    "list_losses": list_losses, "expert_score_table": expert_score_table, "average_ranks": average_ranks, "score_ranks": score_ranks,
    "pairs_per_prompt": pairs_per_prompt, "category_difficulty_crosstab": category_difficulty_crosstab,
    "feature_statistics": feature_statistics, "feature_correlations": feature_correlations, "feature_coverage": feature_coverage,
    "part_histogram": part_histogram, "pair_diversity": pair_diversity, "diversity_summary": diversity_summary,
    "confusion_cells": confusion_cells, "class_metrics": class_metrics, "overall_class_metrics": overall_class_metrics,
    "temperature_grid": temperature_grid, "best_temperature": best_temperature, "emotion_statistics": emotion_statistics,
}

_MP = with_ctes("margin_pairs") + f", marked AS (SELECT *, {AGREE.format(m='margin')} AS agree FROM margin_pairs) "
_TEST = with_ctes("margin_pairs") + f""", groups AS (SELECT prompt_id, min(category) AS stratum FROM margin_pairs GROUP BY 1), test AS (SELECT prompt_id FROM (
  SELECT prompt_id, row_number() OVER (PARTITION BY stratum ORDER BY {hashed('prompt_id')}, prompt_id) AS rk, count(*) OVER (PARTITION BY stratum) AS n FROM groups) a WHERE rk > floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n)),
marked AS (SELECT *, {AGREE.format(m='dz_alpha')} AS agree FROM margin_pairs WHERE prompt_id IN (SELECT prompt_id FROM test)) """
_SETS = "(), (category), (difficulty)"
ORACLES = {
    "agreement_report": _MP + SLICED.format(pre="", agg=COUNTS, src="marked", sets=_SETS),
    "test_split_agreement": _TEST + SLICED.format(pre="", agg=COUNTS, src="marked", sets=_SETS),
    "strict_metrics": _STRICT,
    "model_report": _LONG + "SELECT * FROM report",
    "model_ranking": _LONG + "SELECT model, acc_ties_half, n FROM report WHERE slice = 'overall'",
    "model_by_category": _LONG + """SELECT model, max(acc_ties_half) FILTER (slice_value = 'A') AS "A", max(acc_ties_half) FILTER (slice_value = 'N') AS "N", max(acc_ties_half) FILTER (slice_value = 'R') AS "R" FROM report WHERE slice = 'category' GROUP BY 1""",
    "model_by_difficulty": _LONG + "SELECT model, " + ", ".join(f"max(acc_ties_half) FILTER (slice_value = '{d}') AS {d}" for d in ("easy", "medium", "hard")) + " FROM report WHERE slice = 'difficulty' GROUP BY 1",
    "best_models": _LONG + "SELECT slice, slice_value, model, acc_ties_half FROM (SELECT *, row_number() OVER (PARTITION BY slice, slice_value ORDER BY acc_ties_half DESC, model) AS rk FROM report) a WHERE rk = 1",
    "model_robustness": _LONG.replace(", 6) + 0.0::DOUBLE) AS acc_ties_half", ", 15) + 0.0::DOUBLE) AS acc_ties_half") + f"SELECT model, {r('var_samp(acc_ties_half)', 9)} AS variance, {r('avg(acc_ties_half)', 9)} AS mean_score FROM report WHERE slice = 'category' GROUP BY 1",
    "model_ablation": _LONG + "SELECT CASE WHEN model IN ('alpha', 'beta', 'gamma', 'delta') THEN 'Expert_' || model || '_only' ELSE model END AS configuration, CASE WHEN model IN ('alpha', 'beta', 'gamma', 'delta') THEN 'individual' ELSE 'full_moe' END AS type, CASE WHEN model IN ('alpha', 'beta', 'gamma', 'delta') THEN model ELSE 'all' END AS expert, acc_ties_half AS score FROM report WHERE slice = 'overall'",
    "method_improvement": _LONG.replace(", 6) + 0.0::DOUBLE) AS acc", ", 15) + 0.0::DOUBLE) AS acc") + f"SELECT b.model AS baseline, {r('(m.acc_no_ties - b.acc_no_ties) / b.acc_no_ties * 100', 4)} AS acc_no_ties, {r('(m.acc_ties_half - b.acc_ties_half) / b.acc_ties_half * 100', 4)} AS acc_ties_half FROM report b, report m WHERE b.slice = 'overall' AND m.slice = 'overall' AND m.model = 'mixture' AND b.model <> 'mixture'",
    "ranker_report": _RANKER,
    "auc_by_category": with_ctes("pairs") + f"SELECT category, n_pos, n_neg, {r('auc')} AS auc FROM ({_auc_sql('pairs', 'dz_alpha', ['category'])}) b",
    "fused_pair_metrics": _FUSEDM,
    "gating_sweep": _SWEEP + "SELECT * FROM sweep",
    "best_gating_threshold": _SWEEP + "SELECT threshold, acc_ties_half FROM sweep ORDER BY acc_ties_half DESC, threshold LIMIT 1",
    "weight_report": _WREP, "weight_distances": _WDIST, "pair_loss_report": _LOSS,
    "outcome_counts": with_ctes("pairs") + f", m AS (SELECT *, (dz_alpha + dz_beta + dz_gamma + dz_delta) / 4 AS prediction FROM pairs) SELECT CASE {AGREE.format(m='prediction')} WHEN 1 THEN 'correct' WHEN -1 THEN 'incorrect' ELSE 'tie' END AS outcome, category, count(*) AS n, {r('avg(prediction)')} AS mean_prediction FROM m GROUP BY 1, 2",
    "expert_disagreements": with_ctes("pairs") + ", s AS (SELECT [sign(dz_alpha), sign(dz_beta), sign(dz_gamma), sign(dz_delta)] AS s FROM pairs) SELECT len(list_filter(s, lambda x: x > 0)) AS num_positive, len(list_filter(s, lambda x: x < 0)) AS num_negative, len(list_filter(s, lambda x: x = 0)) AS num_zero, count(*) AS n FROM s WHERE len(list_distinct(s)) > 1 GROUP BY 1, 2, 3",
    "mixture_only_failures": _MARK + ", x AS (SELECT pair_id, agree AS moe_agreement, " + ", ".join(f"{AGREE.format(m=c)} AS {c}_agreement" for c in DZ_COLUMNS) + " FROM m) SELECT * FROM x WHERE moe_agreement = -1 AND greatest(" + ", ".join(f"{c}_agreement" for c in DZ_COLUMNS) + ") = 1",
    "failure_patterns": _MARK + "SELECT category, difficulty, count(pair_id) AS num_pairs, count(DISTINCT prompt_id) AS num_prompts FROM m WHERE agree = -1 GROUP BY 1, 2",
    "case_studies": _MARK + f"SELECT category, rk AS case_no, pair_id, agree AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {hashed('pair_id')}, pair_id) AS rk FROM m WHERE agree = -1) a WHERE rk <= 2",
    "slice_shares": _MARK + f"SELECT category, difficulty, count(*) AS n, {r('avg((agree = -1)::INT) * 100', 4)} AS failure_rate, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 4)} AS percent FROM m GROUP BY 1, 2",
    "embedding_margin_report": _EMB, "external_score_report": _EXT,
    "list_metrics": _list_sql() + f"SELECT method, prompt_id, n_items, {r('ndcg')} AS ndcg, {r('mrr')} AS mrr, {r('hit')} AS hit FROM metrics",
    "method_report": _list_sql() + f"SELECT method, count(*) AS n_prompts, {_MEANS} FROM metrics GROUP BY 1",
    "random_baseline": _list_sql(3) + f"SELECT 'random' AS method, sum(n)::BIGINT AS n_prompts, {_MEANS} FROM (SELECT method, count(*) AS n, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(hit) AS hit FROM metrics WHERE method LIKE 'random%' GROUP BY 1) a",
    "segment_report": _list_sql().replace("WITH ", f"WITH {with_ctes('prompt_weights')[5:].strip()}, ", 1) + f"SELECT method, c_mktsegment AS segment, count(*) AS n_prompts, {r('avg(ndcg)')} AS ndcg, {r('avg(mrr)')} AS mrr, {', '.join(r(f'avg({w})') + f' AS {w}' for w in W)}, {r('corr(ndcg, w_alpha)')} AS corr_alpha FROM metrics JOIN customer ON c_custkey = prompt_id JOIN prompt_weights USING (prompt_id) GROUP BY 1, 2",
    "list_losses": _LISTLOSS, "expert_score_table": _EXPERT,
    "average_ranks": with_ctes("pairs") + "SELECT pair_id, rank() OVER (PARTITION BY category ORDER BY dz_beta) + (count(*) OVER (PARTITION BY category, dz_beta) - 1) / 2.0::DOUBLE AS avg_rank FROM pairs",
    "score_ranks": with_ctes("weighted_ranking") + "SELECT prompt_id, item_id, row_number() OVER (PARTITION BY prompt_id ORDER BY round(mix_alpha * z_alpha + mix_beta * z_beta + mix_gamma * z_gamma + mix_delta * z_delta, 9) DESC, item_id) AS rank FROM weighted_ranking",
    "pairs_per_prompt": with_ctes("pairs") + f"SELECT sum(n)::BIGINT AS total_pairs, sum(pos)::BIGINT AS a_preferred, {r('avg(n)')} AS mean, {r('stddev_samp(n)')} AS std, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, {r('median(n)')} AS median FROM (SELECT count(*) AS n, sum(y) AS pos FROM pairs GROUP BY prompt_id) a",
    "category_difficulty_crosstab": with_ctes("pairs") + "SELECT category, " + ", ".join(f"count(*) FILTER (difficulty = '{d}') AS {d}" for d in ("easy", "medium", "hard")) + " FROM pairs GROUP BY 1",
    "feature_statistics": _FS, "feature_correlations": _CORR,
    "feature_coverage": with_ctes("pairs") + "SELECT count(*) AS n, " + ", ".join(f"sum((abs({c}) > 1e-8)::INT)::BIGINT AS nonzero_{c}" for c in DZ_COLUMNS) + ", sum((greatest(abs(dz_alpha), abs(dz_beta), abs(dz_gamma), abs(dz_delta)) <= 1e-8)::INT)::BIGINT AS all_zero FROM pairs",
    "part_histogram": with_ctes("pairs") + """SELECT value, count(*) AS n FROM (SELECT unnest([p_type, p_brand]) AS value FROM (SELECT unnest(["movieA", "movieB"]) AS item FROM pairs) a JOIN part ON p_partkey = item) b GROUP BY 1""",
    "pair_diversity": _DIV + f"SELECT prompt_id, total_pairs, unique_items, {r('diversity')} AS diversity, repeated_items, max_appearances FROM d",
    "diversity_summary": _DIV + f"SELECT count(*) AS n_prompts, {r('avg(diversity)')} AS mean_diversity, sum((diversity = 100)::INT)::BIGINT AS perfect, {r('avg((diversity = 100)::INT) * 100')} AS perfect_rate FROM d",
    "confusion_cells": _CLS + "SELECT truth, predicted, count(*) AS n FROM c GROUP BY 1, 2",
    "class_metrics": _CLS + f"SELECT label, support, predicted, tp, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM m",
    "overall_class_metrics": _CLS + f"SELECT sum(support)::BIGINT AS n, {r('sum(tp) / sum(support)')} AS accuracy, {r('sum(tp) / sum(support)')} AS f1_micro, {r('avg(f1)')} AS f1_macro, {r('sum(f1 * support) / sum(support)')} AS f1_weighted, {r('avg(precision)')} AS precision_macro, {r('avg(recall)')} AS recall_macro FROM m",
    "temperature_grid": _TEMP + f"SELECT step, {r('temperature')} AS temperature, {r('nll')} AS nll FROM g",
    "best_temperature": _TEMP + f"SELECT {r('temperature')} AS temperature, {r('nll')} AS nll FROM g ORDER BY round(g.nll, 12), step LIMIT 1",
    "emotion_statistics": with_ctes("emotions") + " UNION ALL ".join(f"SELECT '{e}' AS emotion, {r(f'avg(emo[{i + 1}])')} AS mean, {r(f'stddev_pop(emo[{i + 1}])')} AS std, {r(f'max(emo[{i + 1}])')} AS max FROM emotions" for i, e in enumerate(EMOTIONS)),
}
