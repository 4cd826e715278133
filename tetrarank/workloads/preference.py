"""Preference features, splits, debiasing, targets, mining and model fitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tetrarank.constants import DZ_COLUMNS, EXPERTS
from tetrarank.functions import numeric as nx
from tetrarank.functions import vectors as vx
from tetrarank.operators import collaborative, evaluation, mining, preferences, scale, scoring, splits, targets
from tetrarank.plans import training
from tetrarank.workloads import views as v
from tetrarank.workloads.retrieval import _z_sql, rounded
from tetrarank.workloads.views import hashed, r, uniform, with_ctes

DZ = ", ".join(f"{r(c)} AS {c}" for c in DZ_COLUMNS)


def _list_pairs(spark, sf):
    """Pairs of a customer's parts: every list entry against the entry of the next smaller quantity part key."""
    li = v.table(spark, sf, "orders").join(v.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return li.select(F.col("o_custkey").alias("prompt_id"), F.concat_ws(
        "_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("pair_id"),
        F.col("l_partkey").alias("movieA"), F.col("l_suppkey").alias("movieB"), F.col("l_returnflag").alias("category"))


_LIST_PAIRS = """list_pairs AS (SELECT o_custkey AS prompt_id,
  concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS pair_id,
  l_partkey AS "movieA", l_suppkey AS "movieB", l_returnflag AS category FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def difference_features(spark, sf):
    """dz between the two items of a pair, both looked up in the prompt's list."""
    z = scoring.zscores(v.ranking(spark, sf), ["prompt_id"], {f"score_{e}": f"z_{e}" for e in EXPERTS}, "pop")
    out = preferences.difference_features(_list_pairs(spark, sf), z)
    return rounded(out, *DZ_COLUMNS)


_DIFFERENCES = with_ctes("ranking") + f""", {_LIST_PAIRS}, zs AS (SELECT prompt_id, item_id, {_z_sql()} FROM ranking),
d AS (SELECT p.prompt_id, p.pair_id, "movieA", "movieB", category, {', '.join(f'a.z_{e} - b.z_{e} AS dz_{e}' for e in EXPERTS)}
  FROM list_pairs p JOIN zs a ON a.prompt_id = p.prompt_id AND a.item_id = "movieA" JOIN zs b ON b.prompt_id = p.prompt_id AND b.item_id = "movieB")
SELECT prompt_id, pair_id, "movieA", "movieB", category, {DZ} FROM d WHERE greatest(abs(dz_alpha), abs(dz_beta), abs(dz_gamma), abs(dz_delta)) > 1e-8"""


def pairs_with_signal(spark, sf):
    """Per category, pairs left after dropping those without any signal (tolerance 0.25 here)."""
    kept = preferences.with_signal(v.pairs(spark, sf), tolerance=0.25)
    return kept.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"))


def judged_pairs(spark, sf):
    """Order lines with their label (inner) and order attributes (left)."""
    p = v.pairs(spark, sf)
    judgments = p.select("prompt_id", "pair_id", "y")
    prompts = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prompt_id"), F.col("o_orderpriority").alias("priority"))
    return preferences.judged_pairs(p.select("prompt_id", "pair_id", "movieA", "movieB"), judgments, prompts)


def _attn_family(spark, sf):
    return v.pairs(spark, sf).select("prompt_id", "pair_id", *[
        (F.col(c) * F.lit(0.5) + F.lit(0.1)).alias(c) for c in DZ_COLUMNS])


def combined_features(spark, sf):
    out = preferences.combined_features(v.pairs(spark, sf), _attn_family(spark, sf))
    names = [c for c in out.columns if c not in ("prompt_id", "pair_id", "movieA", "movieB", "category", "difficulty", "y")
             and not c.endswith("argmax_abs")]
    return rounded(out.drop("movieA", "movieB", "category", "difficulty"), *names)


def _shape_sql(p):
    mags = "[" + ", ".join(f"abs({p}_{c})" for c in DZ_COLUMNS) + "]"
    l1 = f"list_sum({mags})"
    l2 = " + ".join(f"{p}_{c} * {p}_{c}" for c in DZ_COLUMNS)
    pos = " + ".join(f"greatest({p}_{c}, 0)" for c in DZ_COLUMNS)
    neg = " + ".join(f"greatest(-{p}_{c}, 0)" for c in DZ_COLUMNS)
    ent = f"-list_sum(list_transform({mags}, lambda m: greatest(m / greatest({l1}, 1e-9::DOUBLE), 1e-12::DOUBLE) * ln(greatest(m / greatest({l1}, 1e-9::DOUBLE), 1e-12::DOUBLE))))"
    return (f"{r(l1)} AS {p}_l1_abs, {r(f'sqrt({l2} + 1e-12::DOUBLE)')} AS {p}_l2, {r(f'list_max({mags})')} AS {p}_max_abs, "
            f"list_position({mags}, list_max({mags})) - 1 AS {p}_argmax_abs, {r(pos)} AS {p}_pos_sum, {r(neg)} AS {p}_neg_sum, "
            f"{r(ent)} AS {p}_entropy, {r(f'list_max({mags}) / greatest({l1}, 1e-9::DOUBLE)')} AS {p}_concentration")


_DOT = " + ".join(f"attn_{c} * sum_{c}" for c in DZ_COLUMNS)
_NORMS = "(" + ") * (".join(f"sqrt({' + '.join(f'{p}_{c} * {p}_{c}' for c in DZ_COLUMNS)} + 1e-12::DOUBLE)" for p in ("attn", "sum")) + ")"
_COMBINED = with_ctes("pairs") + f""", families AS (SELECT prompt_id, pair_id, y, {', '.join(f'{c} AS sum_{c}, {c} * 0.5::DOUBLE + 0.1::DOUBLE AS attn_{c}' for c in DZ_COLUMNS)} FROM pairs)
SELECT prompt_id, pair_id, y, {', '.join(f'{r(f"{p}_{c}")} AS {p}_{c}' for p in ('sum', 'attn') for c in DZ_COLUMNS)},
 {', '.join(f'{r(f"attn_{c}")} AS {c}' for c in DZ_COLUMNS)}, {r(_DOT)} AS sim_attn_sum_dot, {r(f'({_DOT}) / ({_NORMS})')} AS sim_attn_sum_cos,
 {', '.join(f'{r(f"attn_dz_{e} - sum_dz_{e}")} AS delta_dz_{e}' for e in EXPERTS)}, {_shape_sql('attn')}, {_shape_sql('sum')},
 {r('attn_dz_alpha * attn_dz_delta')} AS dz_axd, {r('attn_dz_alpha * attn_dz_beta')} AS dz_axb, {r('attn_dz_beta * attn_dz_gamma')} AS dz_bxg FROM families"""


def derived_signals(spark, sf):
    p = v.pairs(spark, sf)
    out = p.select("pair_id", *preferences.derived_signals())
    return rounded(out, *[c for c in out.columns if c != "pair_id"])


_DERIVED = with_ctes("pairs") + "SELECT pair_id, " + ", ".join(
    f"{r(f'abs({c})')} AS abs_{c}, {r(f'greatest({c}, 0)')} AS pos_{c}, {r(f'greatest(-{c}, 0)')} AS neg_{c}, "
    f"(abs({c}) > 1e-9)::INT::DOUBLE AS hit_{c}" for c in DZ_COLUMNS) + " FROM pairs"


def standardized_features(spark, sf):
    rows = splits.split_by_group(v.pairs(spark, sf), ["prompt_id"], ["category"])
    out = preferences.standardized_by_train(rows, DZ_COLUMNS)
    return rounded(out.select("pair_id", "split", *DZ_COLUMNS), *DZ_COLUMNS)


_SPLIT = f"""groups AS (SELECT prompt_id, min(category) AS stratum FROM pairs GROUP BY 1),
split_of AS (SELECT prompt_id, CASE WHEN rk <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rk <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT prompt_id, row_number() OVER (PARTITION BY stratum ORDER BY {hashed('prompt_id')}, prompt_id) AS rk,
        count(*) OVER (PARTITION BY stratum) AS n FROM groups) a)"""
_STANDARD = with_ctes("pairs") + f", {_SPLIT}, s AS (SELECT * FROM pairs JOIN split_of USING (prompt_id)), t AS (SELECT " + ", ".join(
    f"avg({c}) FILTER (split = 'train') AS mu_{c}, stddev_samp({c}) FILTER (split = 'train') AS sd_{c}" for c in DZ_COLUMNS) \
    + " FROM s) SELECT pair_id, split, " + ", ".join(
    f"{r(f'({c} - mu_{c}) / (CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END)')} AS {c}" for c in DZ_COLUMNS) + " FROM s, t"


def grouped_split(spark, sf):
    out = splits.split_by_group(v.pairs(spark, sf), ["prompt_id"], ["category"])
    return out.select("pair_id", "prompt_id", "split")


def ungrouped_split(spark, sf):
    """No strata: 80/20 by prompt, and 70/15/15 over single documents."""
    by_prompt = splits.split_by_group(v.table(spark, sf, "conversations"), ["conv_id"], train=0.8, val=0.2)
    by_row = splits.split_by_group(v.table(spark, sf, "documents"), ["doc_id"])
    return (by_prompt.groupBy(F.lit("conversations").alias("source"), "split").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(by_row.groupBy(F.lit("documents").alias("source"), "split").agg(F.count(F.lit(1)).alias("n"))))


def _plain_split_sql(table, key, train, val):
    return f"""SELECT {key}, CASE WHEN rk <= floor({train}::DOUBLE * n) THEN 'train' WHEN rk <= floor({train}::DOUBLE * n) + floor({val}::DOUBLE * n) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT {key}, row_number() OVER (ORDER BY {hashed(key)}, {key}) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table}) d) a"""


def stratified_label_split(spark, sf):
    return splits.stratified_split(v.table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "quality", "split")


def split_integrity(spark, sf):
    """Prompts per split and category, and how many prompts leak (none)."""
    rows = splits.split_by_group(v.pairs(spark, sf), ["prompt_id"], ["category"])
    leaks = splits.split_integrity(rows, ["prompt_id"]).agg(F.count(F.lit(1)).alias("leaks"))
    counts = rows.groupBy("split").agg(F.countDistinct("prompt_id").alias("prompts"), F.count(F.lit(1)).alias("pairs"))
    return counts.select("*", leaks.scalar().alias("leaks"))


def balanced_positions(spark, sf):
    out = splits.balance_positions(v.pairs(spark, sf), ["category", "difficulty"], ["pair_id"])
    return rounded(out.select("pair_id", "movieA", "movieB", "y", *DZ_COLUMNS), *DZ_COLUMNS)


def balanced_easy_positions(spark, sf):
    out = splits.balance_positions(v.pairs(spark, sf), ["category"], ["pair_id"], target=0.4, only_easy=True)
    return out.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"),
                                                     F.sum("movieA").alias("sum_a"), F.sum("movieB").alias("sum_b"))


_SURPLUS = "(pos - round_even({t}::DOUBLE * n, 0))"
_BALANCED = with_ctes("pairs") + f""", b AS (SELECT *, count(*) OVER g AS n, sum(y) OVER g AS pos,
  row_number() OVER (PARTITION BY category, difficulty, y ORDER BY {hashed('pair_id')}, pair_id) AS rk FROM pairs WINDOW g AS (PARTITION BY category, difficulty)),
f AS (SELECT *, (y = 1 AND rk <= {_SURPLUS.format(t=0.5)}) OR (y = 0 AND rk <= -{_SURPLUS.format(t=0.5)}) AS flip FROM b)
SELECT pair_id, CASE WHEN flip THEN "movieB" ELSE "movieA" END AS "movieA", CASE WHEN flip THEN "movieA" ELSE "movieB" END AS "movieB",
  CASE WHEN flip THEN 1 - y ELSE y END AS y, {', '.join(f"{r(f'CASE WHEN flip THEN -{c} ELSE {c} END')} AS {c}" for c in DZ_COLUMNS)} FROM f"""
_BALANCED_EASY = with_ctes("pairs") + f""", b AS (SELECT *, difficulty = 'easy' AS ok, count(*) FILTER (difficulty = 'easy') OVER g AS n,
  coalesce(sum(y) FILTER (difficulty = 'easy') OVER g, 0) AS pos,
  row_number() OVER (PARTITION BY category, difficulty = 'easy', y ORDER BY {hashed('pair_id')}, pair_id) AS rk FROM pairs WINDOW g AS (PARTITION BY category)),
f AS (SELECT *, ok AND ((y = 1 AND rk <= {_SURPLUS.format(t=0.4)}) OR (y = 0 AND rk <= -{_SURPLUS.format(t=0.4)})) AS flip FROM b)
SELECT category, difficulty, count(*) AS n, sum(CASE WHEN flip THEN 1 - y ELSE y END)::BIGINT AS positives,
  sum(CASE WHEN flip THEN "movieB" ELSE "movieA" END)::BIGINT AS sum_a, sum(CASE WHEN flip THEN "movieA" ELSE "movieB" END)::BIGINT AS sum_b FROM f GROUP BY 1, 2"""


def shuffled_positions(spark, sf):
    rows = splits.split_by_group(v.pairs(spark, sf), ["prompt_id"], ["category"])
    out = splits.shuffle_positions(rows, ["pair_id"], 0.5, "train", only_easy=True)
    return rounded(out.select("pair_id", "movieA", "movieB", "y", "split", *DZ_COLUMNS), *DZ_COLUMNS)


_SHUFFLED = with_ctes("pairs") + f", {_SPLIT}" + f""", f AS (SELECT *, {uniform('pair_id')} < 0.5 AND split = 'train' AND difficulty = 'easy' AS flip FROM pairs JOIN split_of USING (prompt_id))
SELECT pair_id, CASE WHEN flip THEN "movieB" ELSE "movieA" END AS "movieA", CASE WHEN flip THEN "movieA" ELSE "movieB" END AS "movieB",
  CASE WHEN flip THEN 1 - y ELSE y END AS y, split, {', '.join(f"{r(f'CASE WHEN flip THEN -{c} ELSE {c} END')} AS {c}" for c in DZ_COLUMNS)} FROM f"""


def prompt_design(spark, sf):
    p = v.pairs(spark, sf).withColumn("multi_intent", (F.col("dz_beta") > 0).cast("int"))
    out = evaluation.prompt_design(p, ["category"], ["multi_intent"], ["easy", "hard", "medium", "unknown"])
    names = [c for c in out.columns if c not in ("prompt_id", "category", "difficulty_primary")]
    return rounded(out, *names, digits=5)


_DESIGN_STATS = ", ".join(
    f"{r(f'avg({c})', 5)} AS {c}_mean, {r(f'stddev_pop({c})', 5)} AS {c}_std, {r(f'avg(({c} > 0)::INT)', 5)} AS {c}_pos_frac, "
    + ", ".join(f"{r(f'quantile_cont({c}, {q})', 5)} AS {c}_{n}" for n, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))
    for c in DZ_COLUMNS)
_FRACS = "avg((difficulty = '{}')::INT)"
_DESIGN = with_ctes("pairs") + f"""SELECT prompt_id, arg_min(lower(category), pair_id) AS category, count(*)::DOUBLE AS pairs_per_prompt, {r('avg(y)', 5)} AS share_positive_pairs,
 {r('avg((dz_beta > 0)::INT)', 5)} AS multi_intent, {', '.join(f"{r(_FRACS.format(d), 5)} AS difficulty_frac_{d}" for d in ('easy', 'hard', 'medium'))},
 {r("greatest(1.0::DOUBLE - (" + ' + '.join(_FRACS.format(d) for d in ('easy', 'hard', 'medium')) + "), 0)", 5)} AS difficulty_frac_unknown, {_DESIGN_STATS},
 CASE WHEN {_FRACS.format('easy')} >= greatest({_FRACS.format('hard')}, {_FRACS.format('medium')}) THEN 'easy'
      WHEN {_FRACS.format('hard')} >= {_FRACS.format('medium')} THEN 'hard' ELSE 'medium' END AS difficulty_primary FROM pairs GROUP BY 1"""


def category_flags(spark, sf):
    """All flags of the one-hot design of documents: rows and characters per flag, wide and long form agreeing."""
    d = v.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    table = splits.level_table(d, ["lang", "source"])
    long = splits.one_hot_entries(d, table, ["lang", "source"], "doc_id").groupBy("column", "level", "place").agg(F.count(F.lit(1)).alias("n"))
    wide = splits.one_hot(d, splits.fit_levels(d, ["lang", "source"]), ["n_chars", "absent"], key="doc_id")
    flags = [c for c in wide.columns if "__" in c]
    sums = wide.agg(*[F.struct(F.sum(c).cast("long").alias("flagged"), F.coalesce(F.sum(F.col(c) * F.col("X_n_chars")), F.lit(0.0)).cast("long").alias("n_chars"),
                               F.sum("X_absent").alias("absent")).alias(c) for c in flags])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("s")) for c in flags])).alias("e")).select("e.flag", "e.s.*")
    return each.join(long.withColumn("flag", F.concat(F.lit("X_"), "column", F.lit("__"), "level")), "flag", "left").select(
        "flag", "flagged", "n_chars", "absent", F.coalesce("n", F.lit(0)).alias("n"))


def sparse_design(spark, sf):
    """The one-hot design of documents as sparse rows, with a level per length (as text) beside language and source."""
    d = v.table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("length"), (F.col("n_chars") % 3).alias("rest"))
    columns = ["lang", "source", "length"]
    out = splits.sparse_design(d, splits.level_table(d, columns), columns, ["rest"], key="doc_id")

    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")

    return out.select("doc_id", "size", text(F.col("indices")).alias("indices"), text(F.col("values")).alias("values"))


_SPARSE = """WITH d AS (SELECT doc_id, lang, source, n_chars::VARCHAR AS length, n_chars % 3 AS rest FROM documents),
e AS (UNPIVOT (SELECT doc_id, coalesce(nullif(lower(trim(lang)), ''), 'unknown') AS lang, coalesce(nullif(lower(trim(source)), ''), 'unknown') AS source, coalesce(length, 'unknown') AS length FROM d)
  ON lang, source, length INTO NAME col VALUE level),
l AS (SELECT col, level, row_number() OVER (PARTITION BY col ORDER BY (level <> 'unknown')::INT, level) - 1 AS place
  FROM (SELECT DISTINCT col, level FROM e UNION SELECT unnest(['lang', 'source', 'length']), 'unknown') a),
n AS (SELECT (SELECT count(*) FROM l WHERE col = 'lang') AS n1, (SELECT count(*) FROM l WHERE col = 'source') AS n2, (SELECT count(*) FROM l) AS n3),
x AS (SELECT doc_id, place + CASE col WHEN 'lang' THEN 0 WHEN 'source' THEN n1 ELSE n1 + n2 END AS i, 1 AS x FROM e JOIN l USING (col, level), n
  UNION ALL SELECT doc_id, n3, rest FROM d, n WHERE rest <> 0)
SELECT doc_id, any_value(n3) + 1 AS size, string_agg(i::BIGINT, ',' ORDER BY i) AS indices, string_agg(x::BIGINT, ',' ORDER BY i) AS values FROM x, n GROUP BY doc_id"""


def entropy_bins(spark, sf):
    """Customers by quantile bin of their weights' entropy."""
    from tetrarank.functions import distributions as dx
    w = v.prompt_weights(spark, sf).withColumn("entropy", F.round(dx.entropy(F.array(*[F.col(f"w_{e}") for e in EXPERTS])), 9))
    out = splits.entropy_bins(w, "entropy")
    return out.groupBy("entropy_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("entropy"), 6).alias("low"),
                                          F.round(F.max("entropy"), 6).alias("high"))


_ENT = "-(" + " + ".join(f"greatest(w_{e}, 1e-9::DOUBLE) * ln(greatest(w_{e}, 1e-9::DOUBLE))" for e in EXPERTS) + ")"
_BINS = with_ctes("prompt_weights") + f""", x AS (SELECT {r(_ENT, 9)} AS e FROM prompt_weights),
q AS (SELECT {', '.join(f'quantile_cont(e, {i / 5}) AS q{i}' for i in range(1, 5))} FROM x)
SELECT entropy_bin, count(*) AS n, {r('min(e)')} AS low, {r('max(e)')} AS high FROM (SELECT e, (e > q1)::INT + (e > q2)::INT + (e > q3)::INT + (e > q4)::INT AS entropy_bin FROM x, q) a GROUP BY 1"""


def category_folds(spark, sf):
    """Documents folded by source, sources spread evenly."""
    d = v.table(spark, sf, "documents").select("doc_id", "source", F.lit(0).alias("bin"))
    out = splits.assign_folds(d, ["doc_id"], "source", "bin", 5)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


def ranked_folds(spark, sf):
    """Prompts folded by md5 rank within the category."""
    g = v.pairs(spark, sf).select("prompt_id", "category").distinct()
    return splits.fold_by_rank(g, ["prompt_id"], ["category"], 5)


def mixture_targets(spark, sf):
    p = v.weighted_pairs(spark, sf)
    out = targets.mixture_targets(p, [f"w_{e}" for e in EXPERTS])
    return rounded(out, *targets.WEIGHTS)


_MIXT = with_ctes("weighted_pairs") + "SELECT prompt_id, pairs_used, " + ", ".join(
    f"{r(f'm_{e} / (m_alpha + m_beta + m_gamma + m_delta)')} AS w_{e}" for e in EXPERTS) + " FROM (SELECT prompt_id, count(*) AS pairs_used, " + ", ".join(
    f"arg_min(w_{e}, pair_id) AS m_{e}" for e in EXPERTS) + " FROM weighted_pairs GROUP BY 1) a"


def _customer_pairs(spark, sf):
    """Pairs with the customer as prompt, so prompts have enough pairs for a fit."""
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"), "o_custkey")
    return v.pairs(spark, sf).join(o, "prompt_id").drop("prompt_id").withColumnRenamed("o_custkey", "prompt_id")


def logit_targets(spark, sf):
    out = targets.prompt_targets(_customer_pairs(spark, sf))
    return rounded(out, *targets.WEIGHTS, "auc_fit", digits=4)


def mined_pairs(spark, sf):
    lists = v.ranking(spark, sf).withColumn("combined", F.col("gt_score"))
    return mining.mine_pairs(lists, score="combined")


_GAP = "abs(a.s - p.s)"
#: The greedy choice as a walk over the options of all prompts at once, an option a step.
_MINED = with_ctes("ranking").replace("WITH ", "WITH RECURSIVE ", 1) + f""", ranked AS (SELECT prompt_id AS q, item_id AS item, gt_score AS s, row_number() OVER (PARTITION BY prompt_id ORDER BY gt_score DESC, item_id) AS rk,
  count(*) OVER (PARTITION BY prompt_id) AS n FROM ranking),
pools AS (SELECT *, rk <= greatest(50, n // 10) AS top, rk > n - greatest(50, n // 10) AS low, rk > greatest(50, n // 10) AND rk <= n - greatest(50, n // 10) AS mid FROM ranked),
roles AS (SELECT q, item, s, 1 AS lv, 'easy' AS level, top AS ao, low AS po FROM pools UNION ALL SELECT q, item, s, 2, 'medium', mid, mid FROM pools UNION ALL SELECT q, item, s, 3, 'hard', top, top FROM pools),
anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, level ORDER BY ao DESC, {hashed('q', 'item', 'level')}, item) AS an FROM roles) x WHERE an <= 9),
met AS (SELECT a.q, a.lv, a.level, a.an, a.item AS a, p.item AS p, a.s AS sa, p.s AS sp, p.po,
  p.po AND CASE a.level WHEN 'medium' THEN {_GAP} > 0.2::DOUBLE AND {_GAP} < 0.5::DOUBLE WHEN 'hard' THEN {_GAP} < 0.2::DOUBLE ELSE true END AS band
  FROM anchors a JOIN roles p ON a.q = p.q AND a.level = p.level AND a.item <> p.item),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, level, an ORDER BY band DESC, po DESC, {hashed('q', 'a', 'p')}, p) AS pn FROM met) x WHERE pn <= 9),
options AS (SELECT *, lv * 100 + an AS anchor_key, least(a, p) || '-' || greatest(a, p) AS pair, row_number() OVER (PARTITION BY q ORDER BY lv, an, pn) AS t FROM cut),
walk AS (
  SELECT q, 0::BIGINT AS t, 0 AS lv, 0 AS made, 0::BIGINT AS done, []::BIGINT[] AS used, []::VARCHAR[] AS taken, false AS ok, ''::VARCHAR AS level, 0::BIGINT AS a, 0::BIGINT AS p, 0.0::DOUBLE AS sa, 0.0::DOUBLE AS sp
  FROM (SELECT DISTINCT q FROM options) x
  UNION ALL
  SELECT q, t, lv, made + ok::INT, CASE WHEN ok THEN anchor_key ELSE done END, CASE WHEN ok THEN list_concat(used, [a, p]) ELSE used END, CASE WHEN ok THEN list_append(taken, pair) ELSE taken END, ok, level, a, p, sa, sp
  FROM (SELECT o.q, o.t, o.lv, CASE WHEN o.lv <> w.lv THEN 0 ELSE w.made END AS made, w.done, w.used, w.taken, o.level, o.a::BIGINT AS a, o.p::BIGINT AS p, o.sa, o.sp, o.anchor_key, o.pair,
      (o.lv <> w.lv OR w.made < 3) AND w.done <> o.anchor_key AND len(list_filter(w.used, lambda u: u = o.a)) < 3 AND len(list_filter(w.used, lambda u: u = o.p)) < 3 AND NOT list_contains(w.taken, o.pair) AS ok
    FROM walk w JOIN options o ON o.q = w.q AND o.t = w.t + 1) x)
SELECT q AS prompt_id, q || '_' || level || '_' || made AS pair_id, level AS difficulty, a AS "movieA", p AS "movieB", sa AS score_a, sp AS score_b,
  CASE WHEN sa - sp >= 0 THEN 1 ELSE -1 END AS m1_gt_m2, CASE WHEN sa - sp >= 0 THEN -1 ELSE 1 END AS m2_gt_m1,
  round(least(CASE level WHEN 'easy' THEN 0.8::DOUBLE + 0.2::DOUBLE * step WHEN 'medium' THEN 0.5::DOUBLE + 0.3::DOUBLE * step ELSE 0.4::DOUBLE + 0.2::DOUBLE * step END, 1.0::DOUBLE), 3) AS confidence
FROM (SELECT *, least(abs(sa - sp) / 0.5::DOUBLE, 1.0::DOUBLE) AS step FROM walk WHERE ok) x"""


def mined_pair_rules(spark, sf):
    """Pairs per difficulty for lists of seven items or more, and broken rules over all lists: an item used over three
    times, a pair mined twice, a label against the scores."""
    lists = v.ranking(spark, sf)
    long = lists.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_items"))
    pairs = mined_pairs(spark, sf).join(long, "prompt_id")
    both = F.array(F.least("movieA", "movieB"), F.greatest("movieA", "movieB"))
    uses = pairs.select("prompt_id", F.explode(F.array("movieA", "movieB")).alias("i")).groupBy("prompt_id", "i").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    twice = pairs.groupBy("prompt_id", both.alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sign = pairs.where((F.col("score_a") >= F.col("score_b")) != (F.col("m1_gt_m2") == 1))
    broken = uses.select(F.lit("uses").alias("rule")).unionByName(twice.select(F.lit("twice").alias("rule"))).unionByName(sign.select(F.lit("sign").alias("rule")))
    counted = pairs.where("n_items >= 7").groupBy(F.concat(F.lit("pairs "), F.col("difficulty")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame([("uses",), ("twice",), ("sign",)], "rule string")
    return counted.unionByName(rules.join(broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n")))


def pair_item_features(spark, sf):
    """Overlap features and hardness of supplier-part pairs, from part attributes."""
    part = v.table(spark, sf, "part")

    def side(s):
        return part.select(F.col("p_partkey").alias(f"k{s}"), F.array("p_type").alias(f"g{s}"), F.col("p_size").alias(f"y{s}"),
                           F.split("p_name", " ").alias(f"t{s}"), F.col("p_retailprice").alias(f"r{s}"))

    p = v.pairs(spark, sf).select("pair_id", F.col("movieA").alias("ka"), F.col("movieB").alias("kb"), "difficulty")
    rows = p.join(side("a"), "ka").join(side("b"), "kb")
    features = preferences.pair_item_features(F.col("ga"), F.col("gb"), F.col("ya"), F.col("yb"), F.col("ta"), F.col("tb"))
    diffs = [(F.col("ya") - F.col("yb")) / 50.0, (F.col("ra") - F.col("rb")) / 997.0]
    weights = [F.lit(0.5), F.lit(0.5)]
    out = rows.select("pair_id", *features, nx.hardness(diffs, weights).alias("hardness"),
                      nx.top_signals(diffs, weights, ["size", "price"]).alias("signals"),
                      nx.pair_confidence((F.col("ra") - F.col("rb")) / 997.0, F.col("difficulty")).alias("confidence"))
    return rounded(out, "keywords_overlap", "hardness")


_DA, _DB = "(a.p_size - b.p_size) / 50.0::DOUBLE", "(a.p_retailprice - b.p_retailprice) / 997.0::DOUBLE"
_STEP = f"least(abs({_DB}) / 0.5::DOUBLE, 1.0::DOUBLE)"
_ITEMF = with_ctes("pairs") + f"""SELECT pair_id, a.p_type = b.p_type AS same_genre, abs(a.p_size - b.p_size) < 10 AS same_decade,
 {r("len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' '))))")} AS keywords_overlap,
 {r(f'least(greatest(1 - (abs({_DA}) * 0.5::DOUBLE + abs({_DB}) * 0.5::DOUBLE), 0), 1)')} AS hardness,
 CASE WHEN abs({_DA}) * 0.5::DOUBLE >= abs({_DB}) * 0.5::DOUBLE THEN CASE WHEN {_DA} = 0 THEN 'size' WHEN {_DB} = 0 THEN 'size' ELSE 'size and price' END
      ELSE CASE WHEN {_DA} = 0 THEN 'price' ELSE 'price and size' END END AS signals,
 round(least(CASE difficulty WHEN 'easy' THEN 0.8::DOUBLE + 0.2::DOUBLE * {_STEP} WHEN 'medium' THEN 0.5::DOUBLE + 0.3::DOUBLE * {_STEP} ELSE 0.4::DOUBLE + 0.2::DOUBLE * {_STEP} END, 1.0::DOUBLE), 3) AS confidence
 FROM pairs JOIN part a ON a.p_partkey = "movieA" JOIN part b ON b.p_partkey = "movieB" """


def nested_pair_batches(spark, sf):
    nested = preferences.nested_pairs(v.pairs(spark, sf).select("prompt_id", "pair_id", "y"), batch=4)
    return nested.groupBy("batch", "n_pairs").agg(F.count(F.lit(1)).alias("rows"))


def calibrated_margins(spark, sf):
    m = nx.calibrated_margin(F.col("margin"), F.col("difficulty"), "easy:0.65,medium:1.0", "hard:0.1")
    out = v.margin_pairs(spark, sf).select("pair_id", m.alias("margin"))
    return rounded(out, "margin")


# --- fitting: no SQL equivalent ---------------------------------------------------------------------------

def _split_pairs(spark, sf):
    """Pairs with their split, stored once: fits and reports read them many times."""
    p = splits.split_by_group(v.pairs(spark, sf), ["prompt_id"], ["category"])
    return scale.stored(p.select("split", "y", "category", "difficulty", *DZ_COLUMNS), "split")


def linear_ranker(spark, sf):
    """Fitted and normalized weights, and the agreement they reach."""
    p = _split_pairs(spark, sf)
    weights = training.fit_linear_ranker(p.where("split = 'train'"))
    scored = p.where("split = 'test'").withColumn("margin", training.linear_margin(weights))
    report = evaluation.ranker_report(scored)
    return report.select("*", *[F.lit(round(w, 4)).alias(f"weight_{e}") for w, e in zip(training.l1_normalized(weights), EXPERTS)])


def linear_ranker_optimum(spark, sf):
    """Gradient of the loss over all pairs at the fitted weights: zero."""
    p = v.pairs(spark, sf)
    return rounded(training.logistic_gradient(p, training.fit_linear_ranker(p)), "gradient", digits=4)


def logit_target_optimum(spark, sf):
    """Per-prompt fits: how many there are, how many converged, and the largest gradient of the penalized loss."""
    base = targets.stored_pairs(_customer_pairs(spark, sf))
    fits = targets.prompt_logits(base, 5.0)
    margin = sum((F.col(f"x{i}") * F.col(f"c{i}") for i in range(1, 4)), F.col("x0") * F.col("c0"))
    weight = F.when(F.col("y") == 1, F.col("n") / (2.0 * F.col("pos"))).otherwise(F.col("n") / (2.0 * (F.col("n") - F.col("pos"))))
    error = F.lit(5.0) * weight * (nx.sigmoid(margin) - F.col("y"))
    sums = base.join(fits, "prompt_id").groupBy("prompt_id").agg(F.max("converged").alias("converged"), *[
        (F.sum(error * F.col(f"x{i}")) + F.max(f"c{i}")).alias(f"g{i}") for i in range(4)])
    return sums.agg(F.count(F.lit(1)).alias("prompts"), F.sum(F.col("converged").cast("int")).alias("converged"),
                    F.round(F.max(F.greatest(*[F.abs(f"g{i}") for i in range(4)])), 5).alias("gradient"))


def nonlinear_ranker(spark, sf):
    p = _split_pairs(spark, sf)
    model = training.fit_nonlinear_ranker(p.where("split = 'train'"), max_iter=100)
    return evaluation.ranker_report(training.nonlinear_margin(model, p.where("split = 'test'")))


def antisymmetric_ranker(spark, sf):
    """Report of the hidden-layer ranker on the test split."""
    p = _split_pairs(spark, sf)
    network = training.fit_antisymmetric_ranker(p.where("split = 'train'"))
    return evaluation.ranker_report(p.where("split = 'test'").withColumn("margin", training.antisymmetric_margin(network)))


def antisymmetric_ranker_optimum(spark, sf):
    """Gradient of the penalized loss over all pairs at the fitted network: zero; and the largest sum of a margin and that of the exchanged pair: zero."""
    p = v.pairs(spark, sf)
    network = training.fit_antisymmetric_ranker(p)
    gradients = training.antisymmetric_gradient(p, network, 0.01)
    margin = training.antisymmetric_margin(network)
    turned = p.select(margin.alias("m"), *[(-F.col(c)).alias(c) for c in DZ_COLUMNS])
    odd = turned.agg(F.max(F.abs(F.col("m") + margin)).alias("gradient")).select(F.lit("exchanged").alias("parameter"), "gradient")
    return rounded(gradients.unionByName(odd), "gradient", digits=4)


def _quality_of(report, name):
    return report.select(F.lit(name).alias("model"), (F.col("accuracy") >= 0.6).alias("accurate"), (F.col("auc") >= 0.6).alias("ranked"))


def ranker_thresholds(spark, sf):
    """Whether the fitted rankers reach accuracy and AUC of 0.6 on prompts that they have not seen."""
    p = _split_pairs(spark, sf)
    train, test = p.where("split = 'train'"), p.where("split = 'test'")
    margins = {"linear": test.withColumn("margin", training.linear_margin(training.fit_linear_ranker(train))),
               "sigmoid": training.nonlinear_margin(training.fit_nonlinear_ranker(train, max_iter=100), test),
               "antisymmetric": test.withColumn("margin", training.antisymmetric_margin(training.fit_antisymmetric_ranker(train)))}
    out = [_quality_of(evaluation.fused_pair_metrics(m), name) for name, m in margins.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _design(spark, sf):
    p = _customer_pairs(spark, sf)
    design = evaluation.prompt_design(p, ["category"], [], ["easy", "medium", "hard", "unknown"])
    weights = v.prompt_weights(spark, sf)
    return p, design.join(weights, "prompt_id")


FEATURES = [f"{c}_{s}" for c in DZ_COLUMNS for s in ("mean", "std", "pos_frac", "q10", "q50", "q90")]


def weight_heads(spark, sf):
    """Cross-validated metrics of four boosted heads on prompt features."""
    p, design = _design(spark, sf)
    scale.checkpoint_dir(spark)
    folded = splits.fold_by_rank(design, ["prompt_id"], [], 3).checkpoint()
    metrics, _ = training.cross_validate(folded, p, FEATURES, [f"w_{e}" for e in EXPERTS], 3, trees=15)
    return evaluation.fold_summary(metrics, ["accuracy", "auc", "logloss"])


def _folds(spark, design):
    scale.checkpoint_dir(spark)
    return splits.fold_by_rank(design, ["prompt_id"], [], 3).checkpoint()


def fold_metric_summary(spark, sf):
    """Mean and deviation over three prompt folds of the metrics of given weights."""
    p = v.weighted_pairs(spark, sf)
    folds = _folds(spark, p.select("prompt_id").distinct())
    metrics = evaluation.fused_pair_metrics(p.join(folds, "prompt_id"), by=["fold"])
    return rounded(evaluation.fold_summary(metrics, ["accuracy", "logloss", "auc"]), "mean", "std")


_PR = "least(greatest(1 / (1 + exp(-margin)), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
_FOLDS = f"SELECT prompt_id, (row_number() OVER (ORDER BY {hashed('prompt_id')}, prompt_id) - 1) % 3 AS fold FROM (SELECT DISTINCT prompt_id FROM {{}}) a"
_FOLD_SUMMARY = with_ctes("weighted_pairs") + f""", f AS ({_FOLDS.format('weighted_pairs')}), p AS (SELECT *, {_PR} AS pr FROM weighted_pairs JOIN f USING (prompt_id)),
ranks AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY margin) + (count(*) OVER (PARTITION BY fold, margin) - 1) / 2.0::DOUBLE AS rk FROM p),
areas AS (SELECT fold, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auc FROM ranks GROUP BY fold),
m AS (SELECT fold, avg(((margin > 0) = (y > 0.5))::INT) AS accuracy, avg(-CASE WHEN y > 0.5 THEN ln(pr) ELSE ln(1 - pr) END) AS logloss FROM p GROUP BY fold),
u AS (UNPIVOT (SELECT accuracy::DOUBLE AS accuracy, logloss::DOUBLE AS logloss, auc::DOUBLE AS auc FROM m JOIN areas USING (fold)) ON accuracy, logloss, auc INTO NAME metric VALUE value)
SELECT metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM u GROUP BY metric"""


def out_of_fold_weights(spark, sf):
    """Cross-validated predictions put together: prompts per fold, prompts that occur twice, rows off the simplex, and whether the weights
    reach an accuracy of 0.6 in the fold."""
    p, design = _design(spark, sf)
    metrics, predictions = training.cross_validate(_folds(spark, design), p, FEATURES, [f"w_{e}" for e in EXPERTS], 3, trees=10)
    names = [f"pred_{e}" for e in EXPERTS]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    off = (F.abs(total - 1.0) > 1e-9) | (F.least(*names) < 0)
    found = predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("prompts"), (F.count(F.lit(1)) - F.countDistinct("prompt_id")).alias("twice"),
                                            F.sum(off.cast("bigint")).alias("off_simplex"))
    return found.join(metrics.select("fold", (F.col("accuracy") >= 0.6).alias("accurate")), "fold")


def saved_heads(spark, sf):
    """Heads written to files and read again: prompts per category whose predicted weights changed, and that are not the softmax of the heads."""
    p, design = _design(spark, sf)
    design = _folds(spark, design)
    heads = training.fit_weight_heads(design.where("fold > 0"), FEATURES, [f"w_{e}" for e in EXPERTS], trees=5)
    folder = scale.shared_path(spark, "heads")
    training.save_heads(heads, folder)
    names = [f"pred_{e}" for e in EXPERTS]
    raw = design
    for head in heads.values():
        raw = head.transform(raw).drop("features")
    total = sum((F.exp(f"head_{e}") for e in EXPERTS[1:]), F.exp(f"head_{EXPERTS[0]}"))
    soft = raw.select("prompt_id", *[(F.exp(f"head_{e}") / total).alias(f"soft_{e}") for e in EXPERTS])
    before = training.predict_weights(heads, design).select("prompt_id", "category", *[F.col(n).alias(f"was_{n}") for n in names])
    after = training.predict_weights(training.load_heads(folder), design).select("prompt_id", *names)
    rows = before.join(after, "prompt_id").join(soft, "prompt_id")
    changed = F.greatest(*[F.abs(F.col(n) - F.col(f"was_{n}")) for n in names]) > 1e-12
    wrong = F.greatest(*[F.abs(F.col(f"pred_{e}") - F.col(f"soft_{e}")) for e in EXPERTS]) > 1e-6
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("prompts"), F.sum(changed.cast("bigint")).alias("changed"), F.sum(wrong.cast("bigint")).alias("not_softmax"))


_OUT_OF_FOLD = with_ctes("pairs", "prompt_weights") + f""", q AS (SELECT DISTINCT o_custkey AS prompt_id FROM pairs JOIN orders ON o_orderkey = pairs.prompt_id JOIN prompt_weights w ON w.prompt_id = o_custkey),
f AS ({_FOLDS.format('q')}) SELECT fold, count(*) AS prompts, 0 AS twice, 0 AS off_simplex, true AS accurate FROM f GROUP BY fold"""
_SAVED = with_ctes("pairs", "prompt_weights") + """, q AS (SELECT o_custkey AS prompt_id, arg_min(category, pair_id) AS category FROM pairs JOIN orders ON o_orderkey = pairs.prompt_id GROUP BY 1)
SELECT lower(category) AS category, count(*) AS prompts, 0 AS changed, 0 AS not_softmax FROM q JOIN prompt_weights USING (prompt_id) GROUP BY 1"""


def _order_ratings(spark, sf):
    o, li = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.sum("l_quantity").cast("double").alias("rating"))


def factor_optimum(spark, sf):
    """Users with factors, and the largest residual of their normal equations, relative to the largest right side: zero.

    Given the item factors a user's factors x solve (Y'Y + sum r y y' + 0.1 n I) x = sum (1 + r) y over the n liked items.
    """
    scale.checkpoint_dir(spark)
    liked = scale.stored(_order_ratings(spark, sf).where("rating >= 25"), "liked")
    users, items = (t.checkpoint() for t in training.fit_factors(liked, threshold=25.0, max_iter=3))
    rank = (items.select(F.size("vector")).first() or [0])[0]
    y = items.select("item_id", F.posexplode("vector").alias("i", "yi"), "vector")
    square = y.select("i", F.posexplode("vector").alias("j", "yj"), "yi").groupBy("i", "j").agg(F.sum(F.col("yi").cast("double") * F.col("yj").cast("double")).alias("s"))
    square = {(row.i, row.j): row.s for row in square.collect()}  # rank * rank numbers
    # One row per rating with the item's factors goes to its user; there all sums of the user are made.
    rated = liked.select("user_id", "item_id", F.col("rating").cast("float").cast("double").alias("r")).join(items, "item_id")
    rated = rated.join(users.withColumnRenamed("vector", "u"), "user_id").withColumn("a", F.col("r") * vx.dot(F.col("u"), F.col("vector")) - F.col("r") - 1.0)
    own = [F.col("vector")[i].cast("double") for i in range(rank)]
    sums = rated.groupBy("user_id").agg(
        F.first("u").alias("u"), F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("a") * yi) for yi in own]).alias("a"),
        F.array(*[F.sum((1.0 + F.col("r")) * yi) for yi in own]).alias("b"))
    x = [F.col("u")[j].cast("double") for j in range(rank)]
    gram = F.array(*[sum((F.lit(square[i, j]) * x[j] for j in range(rank)), F.lit(0.0)) for i in range(rank)])
    sides = sums.select("user_id", "n", "a", "b", "u", gram.alias("g"))
    rows = sides.select("user_id", "n", F.explode(F.arrays_zip("a", "b", "g", "u")).alias("e"))
    residual = F.col("e.g") + F.col("e.a") + 0.1 * F.col("n") * F.col("e.u").cast("double")
    return rows.agg(F.countDistinct("user_id").alias("users"), F.round(F.max(F.abs(residual)) / F.max(F.abs("e.b")), 3).alias("residual"))


_FACTOR_OPTIMUM = """SELECT count(DISTINCT u) AS users, 0.0::DOUBLE AS residual FROM (
  SELECT o_custkey AS u FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey HAVING sum(l_quantity) >= 25) a"""


def weight_head_report(spark, sf):
    p, design = _design(spark, sf)
    names = [f"w_{e}" for e in EXPERTS]
    scale.checkpoint_dir(spark)
    folded = splits.fold_by_rank(design, ["prompt_id"], [], 3).checkpoint()
    heads = training.fit_weight_heads(folded.where("fold > 0"), FEATURES, names, trees=15)
    distances, _ = training.evaluate_heads(heads, folded.where("fold = 0"), p, names, ["category"])
    return distances


def user_item_factors(spark, sf):
    """Factors of order quantities, and each user's ten best parts by cosine."""
    ratings = scale.stored(_order_ratings(spark, sf).where("rating >= 25"), "liked")
    scale.drop_unused(spark)
    users, items = training.fit_factors(ratings, threshold=25.0, max_iter=10)
    return collaborative.user_top_items(users, items, 10)


def _network():
    """A fixed small network: 20 features, 8 hidden units, 4 weights."""
    import numpy as np
    rng = np.random.default_rng(7)
    return {"w1": rng.normal(size=(8, 20)), "b1": rng.normal(size=8), "w2": rng.normal(size=(4, 8)), "b2": rng.normal(size=4),
            "a": np.ones(4), "b": np.zeros(4), "bias": np.zeros(20), "temp": 1.5}


def gated_mixture_scores(spark, sf):
    """Forward pass of a fixed small network over all pairs, per category."""
    rows = training.feature_matrix(v.pairs(spark, sf), [], {}).withColumn("x", F.transform(
        training.vector_to_array("features"), lambda x: x)).drop("features")
    out = training.gated_mixture(rows.select("pair_id", "category", "x"), "x", _network())
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"),
                                       *[F.round(F.avg(f"w_{e}"), 6).alias(f"mean_w_{e}") for e in EXPERTS])


def _gated_sql():
    p = _network()
    x = [*DZ_COLUMNS, *[e.format(c=c) for c in DZ_COLUMNS for e in ("abs({c})", "greatest({c}, 0)", "greatest(-{c}, 0)", "(abs({c}) > 1e-9)::INT::DOUBLE")]]

    def affine(row, inputs, bias):
        return " + ".join([*[f"({float(w)!r})::DOUBLE * ({i})" for w, i in zip(row, inputs)], f"({float(bias)!r})::DOUBLE"])

    hidden = ", ".join(f"greatest({affine(w, x, b)}, 0) AS h{j}" for j, (w, b) in enumerate(zip(p["w1"], p["b1"])))
    logits = ", ".join(f"exp(({affine(w, [f'h{j}' for j in range(8)], b)}) / 1.5::DOUBLE) AS e{k}" for k, (w, b) in enumerate(zip(p["w2"], p["b2"])))
    total = "(e0 + e1 + e2 + e3)"
    margin = " + ".join(f"e{k} / {total} * {c}" for k, c in enumerate(DZ_COLUMNS))
    return with_ctes("pairs") + f", h AS (SELECT *, {hidden} FROM pairs), l AS (SELECT *, {logits} FROM h) SELECT category, count(*) AS n, {r(f'avg({margin})')} AS mean_margin, " + ", ".join(
        f"{r(f'avg(e{k} / {total})')} AS mean_w_{e}" for k, e in enumerate(EXPERTS)) + " FROM l GROUP BY 1"


QUERIES = {
    "difference_features": difference_features, "pairs_with_signal": pairs_with_signal, "judged_pairs": judged_pairs,
    "combined_features": combined_features, "derived_signals": derived_signals, "standardized_features": standardized_features,
    "grouped_split": grouped_split, "ungrouped_split": ungrouped_split, "stratified_label_split": stratified_label_split,
    "split_integrity": split_integrity, "balanced_positions": balanced_positions, "balanced_easy_positions": balanced_easy_positions,
    "shuffled_positions": shuffled_positions, "prompt_design": prompt_design, "category_flags": category_flags,
    "entropy_bins": entropy_bins, "category_folds": category_folds, "ranked_folds": ranked_folds, "mixture_targets": mixture_targets,
    "logit_targets": logit_targets, "mined_pairs": mined_pairs, "pair_item_features": pair_item_features,
    "nested_pair_batches": nested_pair_batches, "calibrated_margins": calibrated_margins, "linear_ranker": linear_ranker,
    "antisymmetric_ranker": antisymmetric_ranker, "antisymmetric_ranker_optimum": antisymmetric_ranker_optimum, "ranker_thresholds": ranker_thresholds,
    "sparse_design": sparse_design, "fold_metric_summary": fold_metric_summary, "out_of_fold_weights": out_of_fold_weights, "saved_heads": saved_heads,
    "factor_optimum": factor_optimum, "nonlinear_ranker": nonlinear_ranker, "weight_heads": weight_heads, "weight_head_report": weight_head_report,
    "user_item_factors": user_item_factors, "gated_mixture_scores": gated_mixture_scores,
    "mined_pair_rules": mined_pair_rules, "linear_ranker_optimum": linear_ranker_optimum, "logit_target_optimum": logit_target_optimum,
}

_GROUPED = with_ctes("pairs") + f", {_SPLIT}"
ORACLES = {
    "gated_mixture_scores": _gated_sql(),
    "mined_pair_rules": with_ctes("ranking") + """, n AS (SELECT prompt_id, count(*) AS n FROM ranking GROUP BY 1) SELECT 'pairs ' || d AS rule, count(*) * 3 AS n FROM n, (SELECT unnest(['easy', 'medium', 'hard']) AS d) x WHERE n >= 7 GROUP BY d
      UNION ALL SELECT unnest(['uses', 'twice', 'sign']) AS rule, 0 AS n""",
    "linear_ranker_optimum": "SELECT unnest([" + ", ".join(f"'{c}'" for c in DZ_COLUMNS) + "]) AS feature, 0.0::DOUBLE AS gradient",
    "sparse_design": _SPARSE, "fold_metric_summary": _FOLD_SUMMARY, "out_of_fold_weights": _OUT_OF_FOLD, "saved_heads": _SAVED, "factor_optimum": _FACTOR_OPTIMUM,
    "antisymmetric_ranker_optimum": "SELECT unnest([" + ", ".join(f"'{n}'" for n in ["exchanged", *[f"{k}{h}" for h in range(4) for k in "vc"], *[f"w{h}_{c}" for h in range(4) for c in DZ_COLUMNS]])
      + "]) AS parameter, 0.0::DOUBLE AS gradient",
    "ranker_thresholds": "SELECT unnest(['linear', 'sigmoid', 'antisymmetric']) AS model, true AS accurate, true AS ranked",
    "logit_target_optimum": with_ctes("pairs") + """SELECT count(*) AS prompts, count(*) AS converged, 0.0::DOUBLE AS gradient FROM (
      SELECT o_custkey FROM pairs JOIN orders ON o_orderkey = prompt_id GROUP BY 1 HAVING min(y) < max(y)) a""",
    "difference_features": _DIFFERENCES,
    "pairs_with_signal": with_ctes("pairs") + "SELECT category, difficulty, count(*) AS n FROM pairs WHERE greatest(abs(dz_alpha), abs(dz_beta), abs(dz_gamma), abs(dz_delta)) > 0.25 GROUP BY 1, 2",
    "judged_pairs": with_ctes("pairs") + """SELECT prompt_id, pair_id, "movieA", "movieB", y, o.o_orderpriority AS priority FROM pairs LEFT JOIN orders o ON o_orderkey = prompt_id""",
    "combined_features": _COMBINED, "derived_signals": _DERIVED, "standardized_features": _STANDARD,
    "grouped_split": _GROUPED + "SELECT pair_id, prompt_id, split FROM pairs JOIN split_of USING (prompt_id)",
    "ungrouped_split": f"""SELECT 'conversations' AS source, split, count(*) AS n FROM conversations JOIN ({_plain_split_sql('conversations', 'conv_id', 0.8, 0.2)}) s USING (conv_id) GROUP BY 2
      UNION ALL SELECT 'documents' AS source, split, count(*) AS n FROM documents JOIN ({_plain_split_sql('documents', 'doc_id', 0.7, 0.15)}) s USING (doc_id) GROUP BY 2""",
    "stratified_label_split": f"""SELECT doc_id, quality, CASE WHEN rk <= floor(0.8::DOUBLE * n) THEN 'train' WHEN rk <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {hashed('doc_id')}, doc_id) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels) a""",
    "split_integrity": _GROUPED + "SELECT split, count(DISTINCT prompt_id) AS prompts, count(*) AS pairs, 0 AS leaks FROM pairs JOIN split_of USING (prompt_id) GROUP BY 1",
    "balanced_positions": _BALANCED, "balanced_easy_positions": _BALANCED_EASY, "shuffled_positions": _SHUFFLED,
    "prompt_design": _DESIGN,
    "category_flags": "SELECT flag, count(doc_id) AS flagged, coalesce(sum(n_chars), 0)::BIGINT AS n_chars, 0.0::DOUBLE AS absent, count(doc_id) AS n FROM (" + " UNION ALL ".join(
        f"SELECT 'X_{c}__' || l AS flag, doc_id, n_chars FROM (SELECT DISTINCT coalesce(lower({c}), 'unknown') AS l FROM documents UNION SELECT 'unknown') x LEFT JOIN documents ON coalesce(lower({c}), 'unknown') = l"
        for c in ("lang", "source")) + ") a GROUP BY 1",
    "entropy_bins": _BINS,
    "category_folds": """WITH RECURSIVE sizes AS (SELECT coalesce(source, 'unknown') AS s, count(*) AS n FROM documents GROUP BY 1),
      ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, s) AS rk FROM sizes),
      walk(rk, n, fold, loads) AS (SELECT 0::BIGINT, 0::BIGINT, -1, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
        SELECT r.rk, r.n, list_position(w.loads, list_min(w.loads)) - 1, list_transform(range(1, 6), lambda i: w.loads[i] + CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN r.n ELSE 0 END)
        FROM walk w JOIN ranked r ON r.rk = w.rk + 1)
      SELECT fold::BIGINT AS fold, sum(n)::BIGINT AS n, count(*) AS sources FROM walk WHERE rk > 0 GROUP BY 1""",
    "ranked_folds": with_ctes("pairs") + f"SELECT prompt_id, category, (row_number() OVER (PARTITION BY category ORDER BY {hashed('prompt_id')}, prompt_id) - 1) % 5 AS fold FROM (SELECT DISTINCT prompt_id, category FROM pairs) a",
    "mined_pairs": _MINED, "mixture_targets": _MIXT, "pair_item_features": _ITEMF,
    "nested_pair_batches": with_ctes("pairs") + """SELECT batch, n_pairs, count(*) AS rows FROM (SELECT prompt_id, (rn - 1) // 4 AS batch, count(*) AS n_pairs FROM (SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id) AS rn FROM pairs) a GROUP BY 1, 2) b GROUP BY 1, 2""",
    "calibrated_margins": with_ctes("margin_pairs") + f"SELECT pair_id, {r('margin * (CASE difficulty WHEN $$easy$$ THEN 0.65::DOUBLE ELSE 1 END) + (CASE difficulty WHEN $$hard$$ THEN 0.1::DOUBLE ELSE 0 END)')} AS margin FROM margin_pairs",
}
