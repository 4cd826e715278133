"""Retrieval, pooling, fusion and cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tetrarank.constants import EMOTIONS, EXPERTS
from tetrarank.functions import distributions as dx
from tetrarank.functions import numeric as nx
from tetrarank.functions import text as tx
from tetrarank.functions import vectors as vx
from tetrarank.operators import bm25, cascade, cells, collaborative, dense, embed, emotion, items, postings, proxy_index, scoring
from tetrarank.plans import hybrid
from tetrarank.workloads import views as v
from tetrarank.workloads.views import r, with_ctes

K = 10
WEIGHTS = {"alpha": 0.4, "beta": 0.3, "gamma": 0.2, "delta": 0.1}


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- BM25 -------------------------------------------------------------------------------------------

def _index(spark, sf):
    return bm25.build_index(v.chunks(spark, sf), "chunk_id", tx.tokens(F.col("text")))


_KEPT = {}


def _postings(spark, sf):
    """The posting index of the chunks: written once per session and table, read by every query after that."""
    key = spark.sparkContext.applicationId, sf
    if key not in _KEPT:
        _KEPT[key] = postings.build_index(v.chunks(spark, sf), "chunk_id", tx.or_empty(F.col("text")))
    return _KEPT[key]


def _bench(spark, sf):
    return v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokens_of_documents(spark, sf):
    toks = tx.tokens(F.col("text"))
    return v.chunks(spark, sf).select("chunk_id", F.size(toks).alias("n_tokens"),
                                      F.md5(F.array_join(toks, " ")).alias("token_hash"))


def boosted_tokens_of_documents(spark, sf):
    words = F.split(F.col("text"), " ")
    toks = tx.boosted_tokens(F.array_join(F.slice(words, 1, 6), " "), F.col("text"), F.col("type"), boost=2)
    return v.chunks(spark, sf).select("chunk_id", F.size(toks).alias("n_tokens"),
                                      F.md5(F.array_join(toks, " ")).alias("token_hash"))


def bm25_postings(spark, sf):
    return _index(spark, sf).postings.select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


def bm25_term_statistics(spark, sf):
    index = _index(spark, sf)
    return rounded(bm25.term_weights(index), "idf")


def bm25_corpus_statistics(spark, sf):
    return rounded(bm25.index_report(_index(spark, sf)), "avgdl")


def bm25_search(spark, sf):
    return postings.search(_postings(spark, sf), _bench(spark, sf), K)


def bm25_search_floored_idf(spark, sf):
    return postings.search(_postings(spark, sf), _bench(spark, sf), K, negative="floor_avg")


def _english(spark, sf):
    return items.filter_items(v.chunks(spark, sf), language=["en", "fr"], kind=[f"src{i}" for i in range(10)])


def bm25_search_filtered(spark, sf):
    allowed = _english(spark, sf).select(F.col("chunk_id").alias("doc_id"))
    return bm25.search(_index(spark, sf).materialized(), _bench(spark, sf), K, doc_filter=allowed)


def _own_filters(spark, sf):
    """Every third query asks for German and French texts, every third for those of even sources, the rest for any."""
    q, n = _bench(spark, sf).select("query_id"), F.col("query_id") % 3
    return q.select("query_id", F.when(n == 0, F.array(F.lit("de"), F.lit("fr"))).alias("f_language"),
                    F.when(n == 1, F.array(*[F.lit(f"src{i}") for i in range(0, 20, 2)])).alias("f_kind"))


def bm25_search_own_filters(spark, sf):
    """Each query with conditions of its own, before the cut."""
    meta = v.chunks(spark, sf).withColumnRenamed("chunk_id", "doc_id")
    return bm25.search(_index(spark, sf).materialized(), _bench(spark, sf), K, filters=_own_filters(spark, sf), meta=meta)


def bm25_search_post_filtered(spark, sf):
    """The same conditions after an oversampled cut: fewer than k may remain."""
    meta = v.chunks(spark, sf).withColumnRenamed("chunk_id", "doc_id")
    return bm25.search(_index(spark, sf).materialized(), _bench(spark, sf), K, filters=_own_filters(spark, sf), meta=meta, filter_mode="post", oversample=5)


_OWN_FILTERS = """(query_id % 3 <> 0 OR original_language IN ('de', 'fr')) AND (query_id % 3 <> 1 OR type IN ('src0', 'src2', 'src4', 'src6', 'src8', 'src10', 'src12', 'src14', 'src16', 'src18'))"""
_BM25_TOP = """SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
ORDER BY score DESC, doc_id) AS rk FROM (SELECT query_id, doc_id, {score} AS score FROM {source}) a) b WHERE rk <= {k}"""
_FLOORED = """SELECT query_id, doc_id, sum(qtf * (CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM idfs) ELSE idf END)
 * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
FROM query_terms JOIN postings USING (term) JOIN idfs USING (term), corpus GROUP BY 1, 2"""
_IDFS = "SELECT term, df, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM term_df, corpus"
_ALLOWED = ("SELECT chunk_id FROM chunks WHERE original_language IN ('en', 'fr') AND type IN ("
            + ", ".join(f"'src{i}'" for i in range(10)) + ")")

# --- dense ------------------------------------------------------------------------------------------


def _queries_as_vectors(spark, sf):
    return v.vectors(spark, sf).select(F.col("item_id").alias("query_id"), "vector")


def _dense(metric):
    def run(spark, sf):
        return dense.search(_queries_as_vectors(spark, sf), v.vectors(spark, sf), K, metric=metric)
    return run


def _cells(metric):
    """The same search over a kept index of cells, written once per session and table."""
    def run(spark, sf):
        key = spark.sparkContext.applicationId, sf, metric
        if key not in _KEPT:
            _KEPT[key] = cells.build_cells(v.vectors(spark, sf), metric)
        return cells.search(_KEPT[key], _queries_as_vectors(spark, sf), K)
    return run


def dense_search_filtered(spark, sf):
    allowed = v.vectors(spark, sf).where("label >= 5")
    return dense.search(_queries_as_vectors(spark, sf), v.vectors(spark, sf), K, allowed=allowed)


def dense_search_post_filtered(spark, sf):
    allowed = v.vectors(spark, sf).where("label >= 5")
    return dense.search(_queries_as_vectors(spark, sf), v.vectors(spark, sf), K, allowed=allowed, filter_mode="post")


def _dense_sql(metric, k=K, where="", post=""):
    q = "(SELECT item_id AS query_id, {} AS qv FROM {})"
    if metric == "l2":
        score = "list_sum(list_transform(range(1, 65), lambda i: (qv[i] - xv[i]) * (qv[i] - xv[i])))"
        q, x, direction = q.format("vector", "vectors"), "(SELECT item_id, vector AS xv FROM vectors)", "ASC"
    else:
        score = "list_sum(list_transform(range(1, 65), lambda i: qv[i] * xv[i]))"
        q, direction = q.format("u", "unit_vectors"), "DESC"
        x = ("(SELECT item_id, u AS xv FROM unit_vectors)" if metric == "cosine"
             else "(SELECT item_id, vector AS xv FROM vectors)")
    cut = f"SELECT * FROM ranked WHERE rk <= {k}"
    if post:
        cut = (f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk2 "
               f"FROM ranked WHERE rk <= {4 * k} AND item_id IN ({post}) QUALIFY rk2 <= {k}")
    return (with_ctes("unit_vectors", "vectors") + f""", ranked AS (
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, item_id) AS rk FROM (
  SELECT query_id, item_id, {r(score)} AS score FROM {q} q, {x} x {where}) s)
SELECT query_id, item_id, score FROM ({cut}) c""")


def dense_probe(spark, sf):
    out = dense.probe(_queries_as_vectors(spark, sf), v.vectors(spark, sf))
    return rounded(out, "query_norm", "cosine_to_mean")


def embedding_dimensions(spark, sf):
    return dense.check_dimensions(v.vectors(spark, sf))


def embedding_norms(spark, sf):
    return rounded(dense.norm_report(v.vectors(spark, sf), "cosine"), "norm_mean", "norm_std", "norm_max")


def embedding_provenance(spark, sf):
    rows = v.vectors(spark, sf).withColumn("embedding_model", F.concat(F.lit("encoder-"), F.col("label").cast("string")))
    return dense.provenance_mismatch(rows, "org/encoder-3")


def unit_vectors(spark, sf):
    u = vx.l2_normalize(F.col("vector"))
    return rounded(v.vectors(spark, sf).select("item_id", u[0].alias("first"), vx.norm(u).alias("norm"),
                                               vx.dot(u, F.reverse(u)).alias("mirrored"),
                                               vx.squared_l2(u, F.reverse(u)).alias("distance")),
                   "first", "norm", "mirrored", "distance")


def hashed_embeddings(spark, sf):
    """Every entry that is not zero of the hashed embeddings of documents."""
    rows = embed.embed_hashed(v.table(spark, sf, "documents"), "doc_id", "text", dim=64, window=256, overlap=32)
    long = rows.select("doc_id", "embedding_model", "embedding_dim", F.posexplode("embedding").alias("dim", "value"))
    return rounded(long.withColumn("value", F.col("value").cast("double")).where("value > 0"), "value", digits=4)


_HASHED = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
 c AS (SELECT *, greatest(ceil((n - 256) / 224.0::DOUBLE) + 1, 1) AS k FROM p),
 s AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS dim, sum((least(k - 1, floor(i / 224.0::DOUBLE)) - greatest(ceil((i - 255) / 224.0::DOUBLE), 0) + 1) / k) AS x FROM c GROUP BY 1, 2)
 SELECT doc_id, dim::INT AS dim, {r('(x / (sqrt(sum(x * x) OVER (PARTITION BY doc_id)) + 1e-12::DOUBLE))::FLOAT::DOUBLE', 4)} AS value, 'hashing-md5-64' AS embedding_model, 64 AS embedding_dim FROM s"""


# --- collaborative, emotion ---------------------------------------------------------------------------

def user_item_cosine(spark, sf):
    return collaborative.user_top_items(v.user_profiles(spark, sf), v.vectors(spark, sf), 50)


def _own_items(spark, sf):
    return v.vectors(spark, sf).select(F.col("label").cast("long").alias("user_id"), "item_id")


def user_scores_of_candidates(spark, sf):
    out = collaborative.candidate_scores(_own_items(spark, sf), v.label_centres(spark, sf), v.vectors(spark, sf))
    return rounded(out, "score")


def _id_map(spark, sf):
    rows = v.vectors(spark, sf).select("item_id", F.floor(F.col("item_id") / 4).alias("movie"))
    return collaborative.unique_id_map(rows, "item_id", "movie")


def user_movie_scores(spark, sf):
    scores = collaborative.candidate_scores(_own_items(spark, sf), v.label_centres(spark, sf), v.vectors(spark, sf))
    best = collaborative.to_movies(scores, _id_map(spark, sf), "max").withColumnRenamed("score", "max_score")
    total = collaborative.to_movies(scores, _id_map(spark, sf), "sum").withColumnRenamed("score", "sum_score")
    return rounded(best.join(total, ["user_id", "movie_id"]), "max_score", "sum_score")


_COS = ("list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i])) / ((sqrt(list_sum(list_transform({a}, lambda x: x * x))) "
        "+ 1e-12::DOUBLE) * (sqrt(list_sum(list_transform({b}, lambda x: x * x))) + 1e-12::DOUBLE))")
_OWN = f"""SELECT c.user_id, x.item_id, {_COS.format(a='c.vector', b='x.vector')} AS score
FROM vectors x JOIN label_centres c ON c.user_id = x.label"""


def js_sql(p, q, mode="sqrt"):
    if mode == "sqrt":
        a, b = (f"list_transform({x}, lambda y: greatest(y, 1e-12::DOUBLE))" for x in (p, q))
        return (f"least(greatest(1 - sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda z: "
                "0.5::DOUBLE * z[1] * (ln(z[1]) - ln(0.5::DOUBLE * (z[1] + z[2]))) "
                "+ 0.5::DOUBLE * z[2] * (ln(z[2]) - ln(0.5::DOUBLE * (z[1] + z[2]))))), 0.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE)")
    return (f"1 - list_sum(list_transform(list_zip({p}, {q}), lambda z: "
            "0.5::DOUBLE * z[1] * ln((z[1] + 1e-10::DOUBLE) / (0.5::DOUBLE * (z[1] + z[2]) + 1e-10::DOUBLE)) "
            "+ 0.5::DOUBLE * z[2] * ln((z[2] + 1e-10::DOUBLE) / (0.5::DOUBLE * (z[1] + z[2]) + 1e-10::DOUBLE)))) / ln(2.0::DOUBLE)")


UNIFORM = "[0.125::DOUBLE, 0.125::DOUBLE, 0.125::DOUBLE, 0.125::DOUBLE, 0.125::DOUBLE, 0.125::DOUBLE, 0.125::DOUBLE, 0.125::DOUBLE]"


def emotion_similarity(spark, sf):
    """Similarity of every query to the items of its user and to items without a profile, in both modes."""
    q = v.queries(spark, sf)
    own = q.select("query_id", "user_id").join(_own_items(spark, sf), "user_id")
    odd = q.select("query_id", "user_id", (F.col("query_id") + 1_000_000).alias("item_id"))
    candidates = own.select("query_id", "item_id").unionByName(odd.select("query_id", "item_id"))
    profiles = q.select("query_id", F.col("prompt_emo").alias("emo"))
    both = emotion.similarity_scores(candidates, profiles, v.emotions(spark, sf), score="js_sqrt")
    both = emotion.similarity_scores(both, profiles, v.emotions(spark, sf), mode="norm", score="js_norm")
    return rounded(both, "js_sqrt", "js_norm")


def emotion_columns(spark, sf):
    named = emotion.named_columns(v.emotions(spark, sf))
    again = emotion.named_columns(emotion.index_from_columns(named, "item_id"))
    return rounded(again, *EMOTIONS)


# --- corpus and pipelines -------------------------------------------------------------------------------

def corpus(spark, sf):
    chunk_map = v.chunks(spark, sf).select("chunk_id", F.col("movie_id").alias("item_id"))
    chunk_vectors = v.vectors(spark, sf).select(F.col("item_id").alias("chunk_id"), "vector").join(
        chunk_map, "chunk_id", "left_semi")
    movies = v.emotions(spark, sf).select(F.floor(F.col("item_id") / 4).alias("item_id"), "emo")
    return hybrid.Corpus(chunk_map, chunk_vectors, _postings(spark, sf), v.label_centres(spark, sf), v.vectors(spark, sf),
                         _id_map(spark, sf), emotion.merge_duplicates(movies, "item_id", "mean", None))


_PIPE = with_ctes("bm25", "unit_vectors", "queries", "label_centres", "emotions") + f""",
beta_hits AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
  FROM (SELECT query_id, doc_id, {r('score')} AS score FROM bm25 WHERE query_id IN (SELECT query_id FROM queries)) a) b WHERE rk <= 20),
unit_queries AS (SELECT query_id, user_id, list_transform(vector, lambda x: x / (sqrt(list_sum(list_transform(vector, lambda y: y * y))) + 1e-12::DOUBLE)) AS qv FROM queries),
alpha_hits AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
  FROM (SELECT query_id, x.item_id AS doc_id, {r('list_sum(list_transform(range(1, 65), lambda i: qv[i] * x.u[i]))')} AS score
        FROM unit_queries, unit_vectors x WHERE x.item_id IN (SELECT chunk_id FROM chunks)) a) b WHERE rk <= 20),
cf AS (SELECT c.user_id, x.item_id, list_sum(list_transform(range(1, 65), lambda i: c.vector[i] * x.u[i]))
   / (sqrt(list_sum(list_transform(c.vector, lambda y: y * y))) + 1e-12::DOUBLE) AS score FROM label_centres c, unit_vectors x),
prior AS (SELECT user_id, item_id // 4 AS item_id, max(score) AS score FROM (
   SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rk
   FROM (SELECT user_id, item_id, {r('score')} AS score FROM cf) a) b WHERE rk <= 15 GROUP BY 1, 2),
movie_emo_raw AS (SELECT item_id // 4 AS item_id, pos, avg(emo[pos]) AS p FROM emotions, range(1, 9) t(pos) GROUP BY 1, 2),
movie_emo AS (SELECT item_id, list(p ORDER BY pos) AS emo FROM (
   SELECT item_id, pos, p / sum(p) OVER (PARTITION BY item_id) AS p FROM movie_emo_raw) a GROUP BY 1),
cf_movies AS (SELECT user_id, item_id // 4 AS item_id, max(score) AS score FROM cf GROUP BY 1, 2)"""


def _table_sql(how, with_prior, zmode):
    """Expert table: candidates, four scores and their z-scores."""
    prior = ("UNION ALL SELECT query_id, item_id, 'prior' AS source, score FROM queries JOIN prior USING (user_id)"
             if with_prior else "")
    out = _PIPE + f""",
stacked AS (SELECT query_id, doc_id // 4 AS item_id, 'alpha' AS source, {how}(score) AS score FROM alpha_hits GROUP BY 1, 2
  UNION ALL SELECT query_id, doc_id // 4 AS item_id, 'beta' AS source, {how}(score) AS score FROM beta_hits GROUP BY 1, 2 {prior}),
joined AS (SELECT query_id, item_id, coalesce(sum(score) FILTER (source = 'alpha'), 0) AS score_alpha,
  coalesce(sum(score) FILTER (source = 'beta'), 0) AS score_beta FROM stacked GROUP BY 1, 2),
scored AS (SELECT j.query_id, j.item_id, score_alpha, score_beta, coalesce(g.score, 0) AS score_gamma,
  {js_sql('q.prompt_emo', f'coalesce(m.emo, {UNIFORM})')} AS score_delta
  FROM joined j JOIN queries q USING (query_id) LEFT JOIN cf_movies g ON g.user_id = q.user_id AND g.item_id = j.item_id
  LEFT JOIN movie_emo m ON m.item_id = j.item_id)"""
    zs = []
    for e in EXPERTS:
        s, over = f"score_{e}", "OVER (PARTITION BY query_id)"
        if zmode == "pop":
            zs.append(f"CASE WHEN stddev_pop({s}) {over} = 0 THEN 0 ELSE ({s} - avg({s}) {over}) / (stddev_pop({s}) {over} + 1e-8::DOUBLE) END AS z_{e}")
        else:
            zs.append(f"CASE WHEN stddev_samp({s}) {over} IS NULL OR stddev_samp({s}) {over} <= 1e-12 THEN 0 ELSE "
                      f"least(greatest(({s} - avg({s}) {over}) / (stddev_samp({s}) {over} + 1e-12::DOUBLE), -3.0::DOUBLE), 3.0::DOUBLE) END AS z_{e}")
    return out + ",\nztable AS (SELECT *, " + ", ".join(zs) + " FROM scored)\n"


def candidate_table(spark, sf):
    out = hybrid.expert_table(corpus(spark, sf), v.queries(spark, sf), 20, how="sum")
    names = [f"{p}_{e}" for p in ("score", "z") for e in EXPERTS]
    return rounded(out.select("query_id", "item_id", *names), *names)


def hybrid_rerank(spark, sf):
    meta = v.chunks(spark, sf).groupBy(F.col("movie_id").alias("item_id")).agg(F.min("type").alias("title"))
    out = hybrid.hybrid_rerank(corpus(spark, sf), v.queries(spark, sf), WEIGHTS, 20, K, how="max", prior_k=15, meta=meta)
    names = [f"contrib_{e}" for e in EXPERTS]
    return rounded(out.select("query_id", "item_id", "rank", "title", "score_final", *names), *names)


_HYBRID = _table_sql("max", True, "clip_sample") + f"""
SELECT f.query_id, f.item_id, f.rk AS rank, t.title, f.score_final, {', '.join(r(f'f.contrib_{e}') + f' AS contrib_{e}' for e in EXPERTS)}
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_final DESC, item_id) AS rk FROM (
  SELECT *, {r('contrib_alpha + contrib_beta + contrib_gamma + contrib_delta')} AS score_final FROM (
    SELECT *, {', '.join(f'{w}::DOUBLE * z_{e} AS contrib_{e}' for e, w in WEIGHTS.items())} FROM ztable) a) b) f
LEFT JOIN (SELECT movie_id AS item_id, min(type) AS title FROM chunks GROUP BY 1) t USING (item_id) WHERE f.rk <= {K}"""


def candidate_union(spark, sf):
    """Which experts put an item on a query's candidate list."""
    c = corpus(spark, sf)
    frames = hybrid.retrieve(c, v.queries(spark, sf), 20, how="max")
    frames["prior"] = hybrid.prior(c, v.queries(spark, sf), 15)
    out = scoring.outer_union(frames, ["query_id", "item_id"])
    return rounded(out, "alpha", "beta", "prior")


_UNION = _table_sql("max", True, "pop") + f"""
SELECT query_id, item_id, {', '.join(r(f"coalesce(sum(score) FILTER (source = '{s}'), 0)") + f' AS {s}' for s in ('alpha', 'beta', 'prior'))}
FROM stacked GROUP BY 1, 2"""


def listwise_candidates(spark, sf):
    """Four expert scores for the movies of each query's user."""
    q = v.queries(spark, sf)
    wanted = q.select("query_id", "user_id").join(_own_items(spark, sf), "user_id").select(
        "query_id", F.floor(F.col("item_id") / 4).alias("item_id")).distinct()
    out = hybrid.score_given_candidates(corpus(spark, sf), wanted, q, 20)
    names = [f"score_{e}" for e in EXPERTS]
    return rounded(out.select("query_id", "item_id", *names), *names)


_LISTWISE = _table_sql("sum", False, "pop") + f"""
SELECT w.query_id, w.item_id, {r('coalesce(j.score_alpha, 0)')} AS score_alpha, {r('coalesce(j.score_beta, 0)')} AS score_beta,
  {r('coalesce(g.score, 0)')} AS score_gamma,
  {r(f"CASE WHEN m.emo IS NULL THEN 0 ELSE {js_sql('q.prompt_emo', 'm.emo', 'norm')} END")} AS score_delta
FROM (SELECT DISTINCT query_id, v.item_id // 4 AS item_id FROM queries q JOIN vectors v ON v.label = q.user_id) w
JOIN queries q USING (query_id) LEFT JOIN joined j ON j.query_id = w.query_id AND j.item_id = w.item_id
LEFT JOIN cf_movies g ON g.user_id = q.user_id AND g.item_id = w.item_id LEFT JOIN movie_emo m ON m.item_id = w.item_id"""


# --- pooling, z, fusion -----------------------------------------------------------------------------------

def _movie_hits(spark, sf):
    return bm25_search(spark, sf).select("query_id", F.floor(F.col("doc_id") / 4).alias("item_id"), "score")


def pooled_scores(spark, sf):
    hits, by = _movie_hits(spark, sf), ["query_id", "item_id"]
    attn = scoring.pool(hits, by, how="attn", temperature=0.5)
    out = scoring.pool(hits, by, how="sum").withColumnRenamed("score", "sum_score")
    out = out.join(scoring.pool(hits, by, how="max").withColumnRenamed("score", "max_score"), by)
    return rounded(out.join(attn.withColumnRenamed("score", "attn_score"), by), "sum_score", "max_score", "attn_score")


_POOLED = with_ctes("bm25") + ", hits AS (SELECT query_id, doc_id // 4 AS item_id, score FROM (" + _BM25_TOP.format(
    score=r("score"), source="bm25", k=K) + f""") h)
SELECT query_id, item_id, {r('sum(score)')} AS sum_score, {r('max(score)')} AS max_score,
  {r('sum(w * score) / sum(w)')} AS attn_score
FROM (SELECT *, exp(greatest((score - max(score) OVER (PARTITION BY query_id, item_id)) / 0.5::DOUBLE, -50.0::DOUBLE)) AS w FROM hits) a
GROUP BY 1, 2"""


def zscore_variants(spark, sf):
    rows = v.ranking(spark, sf)
    rows = scoring.zscores(rows, ["prompt_id"], {"score_beta": "z_pop"}, "pop")
    rows = scoring.zscores(rows, ["prompt_id"], {"score_beta": "z_strict"}, "pop_strict")
    rows = scoring.zscores(rows, ["prompt_id"], {"score_beta": "z_clip"}, "clip_sample")
    return rounded(rows.select("prompt_id", "item_id", "z_pop", "z_strict", "z_clip"), "z_pop", "z_strict", "z_clip")


_ZS = with_ctes("ranking") + f"""
SELECT prompt_id, item_id, {r('CASE WHEN sp = 0 THEN 0 ELSE (s - mu) / (sp + 1e-8::DOUBLE) END')} AS z_pop,
  {r('CASE WHEN sp < 1e-8 THEN 0 ELSE (s - mu) / sp END')} AS z_strict,
  {r('CASE WHEN ss IS NULL OR ss <= 1e-12 THEN 0 ELSE least(greatest((s - mu) / (ss + 1e-12::DOUBLE), -3), 3) END')} AS z_clip
FROM (SELECT prompt_id, item_id, score_beta AS s, avg(score_beta) OVER w AS mu, stddev_pop(score_beta) OVER w AS sp,
  stddev_samp(score_beta) OVER w AS ss FROM ranking WINDOW w AS (PARTITION BY prompt_id)) a"""


def fused_by_prompt_weights(spark, sf):
    rows = v.ranking(spark, sf)
    z = scoring.zscores(rows, ["prompt_id"], {f"score_{e}": f"z_{e}" for e in EXPERTS}, "pop")
    out = scoring.final_top(scoring.fuse(z, v.prompt_weights(spark, sf), query_id="prompt_id"), 5, query_id="prompt_id")
    names = [f"contrib_{e}" for e in EXPERTS]
    return rounded(out.select("prompt_id", "item_id", "rank", "score_final", *names), *names)


def _z_sql(prefix="score_", source="ranking"):
    over = "OVER (PARTITION BY prompt_id)"
    return ", ".join(
        f"CASE WHEN stddev_pop({prefix}{e}) {over} = 0 THEN 0 ELSE ({prefix}{e} - avg({prefix}{e}) {over}) "
        f"/ (stddev_pop({prefix}{e}) {over} + 1e-8::DOUBLE) END AS z_{e}" for e in EXPERTS)


_FUSED = with_ctes("ranking", "prompt_weights") + f"""
SELECT prompt_id, item_id, rk AS rank, score_final, {', '.join(r(f'c_{e}') + f' AS contrib_{e}' for e in EXPERTS)} FROM (
 SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score_final DESC, item_id) AS rk FROM (
  SELECT *, {r('c_alpha + c_beta + c_gamma + c_delta')} AS score_final FROM (
   SELECT z.prompt_id, z.item_id, {', '.join(f'w_{e} * z_{e} AS c_{e}' for e in EXPERTS)}
   FROM (SELECT prompt_id, item_id, {_z_sql()} FROM ranking) z JOIN prompt_weights USING (prompt_id)) a) b) c WHERE rk <= 5"""


def dz_summaries(spark, sf):
    rows = v.ranking_with_weights(spark, sf)
    low = scoring.dz_summary(rows, "prompt_id", prefix="lower_")
    mid = scoring.dz_summary(rows, "prompt_id", median="mean", prefix="mean_")
    return rounded(low.join(mid, "prompt_id"), *[f"{p}_{e}" for p in ("lower", "mean") for e in EXPERTS], digits=9)


_DZ = with_ctes("weighted_ranking") + "SELECT prompt_id, " + ", ".join(
    f"{r(f'max(z_{e}) - quantile_disc(z_{e}, 0.5)', 9)} AS lower_{e}, {r(f'max(z_{e}) - quantile_cont(z_{e}, 0.5)', 9)} AS mean_{e}"
    for e in EXPERTS) + " FROM weighted_ranking GROUP BY 1"


def dominance_gate(spark, sf):
    w = F.array(*[F.col(f"w_{e}") for e in EXPERTS])
    out = v.prompt_weights(spark, sf).select("prompt_id", cascade.gate(w).alias("g")).select("prompt_id", "g.*")
    return rounded(out, "wmax", "entropy_bits", "gap")


_GATE_STATS = """gate AS (SELECT *, ranked[1] AS wmax, ranked[1] - ranked[2] AS gap,
  -list_sum(list_transform(n2, lambda x: greatest(x, 1e-9::DOUBLE) * ln(greatest(x, 1e-9::DOUBLE)))) / ln(2.0::DOUBLE) AS entropy_bits,
  CASE list_position(n, ranked[1]) WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' WHEN 3 THEN 'gamma' ELSE 'delta' END AS dominant FROM (
  SELECT *, list_reverse_sort(n) AS ranked, list_transform(n, lambda x: x / (list_sum(n) + 1e-9::DOUBLE)) AS n2 FROM (
    SELECT *, list_transform(w, lambda x: greatest(x / (list_sum(w) + 1e-9::DOUBLE), 1e-9::DOUBLE)) AS n FROM (
      SELECT *, [w_alpha, w_beta, w_gamma, w_delta] AS w FROM prompt_weights) a) b) c)"""
_GATED = "(wmax >= 0.75 AND entropy_bits <= 1.3 AND gap >= 0.2)"
_GATE = with_ctes("prompt_weights") + f", {_GATE_STATS} SELECT prompt_id, {_GATED} AS gated, dominant, {r('wmax')} AS wmax, " \
    f"{r('entropy_bits')} AS entropy_bits, {r('gap')} AS gap FROM gate"

POOLS = {"alpha": 12, "beta": 12, "gamma": 10, "delta": 10}


def cascade_scores(spark, sf):
    out = cascade.route(v.ranking(spark, sf), v.prompt_weights(spark, sf), query_id="prompt_id", pool_size=POOLS)
    return rounded(out, "score_final")


def cascade_log(spark, sf):
    return rounded(cascade.route_log(v.prompt_weights(spark, sf), query_id="prompt_id"), *[f"w_{e}" for e in EXPERTS])


_ACTIVE = {e: "dominant IN (" + ", ".join(f"'{d}'" for d, kept in cascade.ACTIVE_AFTER.items() if e in kept) + ")"
           if any(e in kept for kept in cascade.ACTIVE_AFTER.values()) else "FALSE" for e in EXPERTS}
_KEPT = {e: f"(CASE WHEN {c} THEN w_{e} ELSE 0 END)" for e, c in _ACTIVE.items()}
_KEPT_SUM = f"({' + '.join(_KEPT.values())} + 1e-9::DOUBLE)"
_ALL_SUM = "(w_alpha + w_beta + w_gamma + w_delta + 1e-9::DOUBLE)"
_CASCADE = with_ctes("ranking", "prompt_weights") + f""", {_GATE_STATS},
gates AS (SELECT *, {_GATED} AS gated FROM gate),
z1 AS (SELECT prompt_id, item_id, {_z_sql()} FROM ranking),
l1 AS (SELECT * FROM z1 JOIN gates USING (prompt_id)),
own AS (SELECT *, CASE dominant WHEN 'alpha' THEN z_alpha WHEN 'beta' THEN z_beta WHEN 'gamma' THEN z_gamma ELSE z_delta END AS own,
  CASE dominant WHEN 'alpha' THEN z_beta WHEN 'beta' THEN z_alpha END AS other,
  CASE WHEN dominant IN ('alpha', 'beta') THEN {POOLS['alpha']} ELSE {POOLS['gamma']} END AS lim FROM l1 WHERE gated),
pool AS (SELECT prompt_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {r('own')} DESC, item_id) AS rk FROM own) a WHERE rk <= lim
  UNION SELECT prompt_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {r('other')} DESC, item_id) AS rk FROM own WHERE other IS NOT NULL) a WHERE rk <= lim),
z2 AS (SELECT prompt_id, item_id, {_z_sql()} FROM ranking JOIN pool USING (prompt_id, item_id))
"""
_CASCADE_SCORES = _CASCADE + f"""SELECT prompt_id, item_id, 1 AS layer, {r(' + '.join(f'w_{e} / {_ALL_SUM} * z_{e}' for e in EXPERTS))} AS score_final FROM l1 WHERE NOT gated
UNION ALL SELECT prompt_id, item_id, 2 AS layer, {r(' + '.join(f'{_KEPT[e]} / {_KEPT_SUM} * z_{e}' for e in EXPERTS))} AS score_final FROM z2 JOIN gates USING (prompt_id)"""
_CASCADE_LOG = _CASCADE + f"""SELECT prompt_id, 1 AS layer, gated, CASE WHEN gated THEN dominant END AS expert, {', '.join(r(f'w_{e} / {_ALL_SUM}') + f' AS w_{e}' for e in EXPERTS)} FROM gates
UNION ALL SELECT prompt_id, 2 AS layer, TRUE AS gated, dominant AS expert, {', '.join(r(f'{_KEPT[e]} / {_KEPT_SUM}') + f' AS w_{e}' for e in EXPERTS)} FROM gates WHERE gated"""


def fusion_weight_rules(spark, sf):
    """Weights with negatives: shifted customer weights, normalized by either rule for a zero sum."""
    rows = v.prompt_weights(spark, sf).select("prompt_id", *[(F.col(f"w_{e}") - 0.3).alias(f"w_{e}") for e in EXPERTS])
    names = [f"w_{e}" for e in EXPERTS]
    plain = rows.select("prompt_id", *scoring.weight_columns(names))
    only = rows.select("prompt_id", *[c.alias(f"b{n}") for n, c in zip(names, scoring.weight_columns(names, True))])
    return rounded(plain.join(only, "prompt_id"), *names, *[f"b{n}" for n in names])


_RAISED = {e: f"greatest(w_{e} - 0.3::DOUBLE, 0.0::DOUBLE)" for e in EXPERTS}
_RSUM = f"({' + '.join(_RAISED.values())})"
_WRULES = with_ctes("prompt_weights") + "SELECT prompt_id, " + ", ".join(
    f"{r(f'CASE WHEN {_RSUM} > 0 THEN {_RAISED[e]} / {_RSUM} ELSE 0 END')} AS w_{e}, "
    f"{r(f'CASE WHEN {_RSUM} > 0 THEN {_RAISED[e]} / {_RSUM} ELSE {int(e == "beta")} END')} AS bw_{e}"
    for e in EXPERTS) + " FROM prompt_weights"


# --- proxy scores -------------------------------------------------------------------------------------------

def proxy_items(spark, sf):
    emo = F.array(*[nx.hash_uniform(F.col("p_partkey"), F.lit(i), seed="emo") for i in range(8)])
    return v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.array("p_type", "p_brand").alias("genres"),
        tx.title_tokens(F.col("p_name")).alias("title_tokens"), dx.simplex(emo).alias("item_emo"))


def proxy_prompts(spark, sf):
    """One prompt per supplier, worded after the part of the same key."""
    p = v.table(spark, sf, "part")
    s = v.table(spark, sf, "supplier").hint("merge").join(p, F.col("s_suppkey") == F.col("p_partkey"))
    emo = F.array(*[nx.hash_uniform(F.col("s_suppkey"), F.lit(i), seed="prompt") for i in range(8)])
    none = F.array().cast("array<string>")
    return s.select(
        F.col("s_suppkey").alias("prompt_id"),
        F.when(F.col("p_size") > 10, F.array("p_type")).otherwise(none).alias("target_genres"),
        F.when(F.col("s_acctbal") < 0, F.array("p_brand")).otherwise(none).alias("negative_genres"),
        tx.prompt_tokens(F.concat(F.lit("a "), F.col("p_name"), F.lit(" for me"))).alias("prompt_tokens"),
        F.array("p_type", "p_brand").alias("liked_genres"),
        F.when(F.col("p_size") > 25, F.array("p_brand", F.lit("Brand#1"))).otherwise(none).alias("disliked_genres"),
        dx.simplex(emo).alias("prompt_emo"), *[F.lit(w).alias(f"w_{e}") for e, w in WEIGHTS.items()])


def proxy_top_items(spark, sf):
    return embed.proxy_top_items(proxy_prompts(spark, sf), proxy_items(spark, sf), K)


def proxy_top_items_indexed(spark, sf):
    """The same over the inverted index of genres and title words."""
    return proxy_index.search(proxy_index.build_index(proxy_items(spark, sf)), proxy_prompts(spark, sf), K)


def proxy_scores_of_offers(spark, sf):
    """All signals for every (supplier, part) that occurs in an order line."""
    offers = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("prompt_id"), F.col("l_partkey").alias("item_id")).distinct()
    # Compressed files make both look small enough to broadcast, which they are not.
    rows = offers.join(proxy_prompts(spark, sf).hint("merge"), "prompt_id").join(proxy_items(spark, sf).hint("merge"), "item_id")
    out = embed.proxy_scores(rows).select("prompt_id", "item_id", *embed.SIGNALS, "combined")
    return rounded(out, *embed.SIGNALS, "combined")


_PROXY = f"""WITH proxy_items AS (SELECT p_partkey AS item_id, [p_type, p_brand] AS genres,
  list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS title_tokens, [{', '.join(v.uniform('p_partkey', str(i), seed='emo') for i in range(8))}] AS eu FROM part),
proxy_prompts AS (SELECT s_suppkey AS prompt_id, CASE WHEN p_size > 10 THEN [p_type] ELSE [] END AS target_genres,
  CASE WHEN s_acctbal < 0 THEN [p_brand] ELSE [] END AS negative_genres,
  list_distinct(regexp_extract_all(lower(p_name), '[a-z'']+')) AS words, [p_type, p_brand] AS liked,
  CASE WHEN p_size > 25 THEN list_distinct([p_brand, 'Brand#1']) ELSE [] END AS disliked,
  [{', '.join(v.uniform('s_suppkey', str(i), seed='prompt') for i in range(8))}] AS pu FROM supplier JOIN part ON s_suppkey = p_partkey),
signals AS (SELECT prompt_id, item_id,
  least(greatest((CASE WHEN len(target_genres) > 0 THEN len(list_intersect(genres, target_genres)) / len(target_genres)::DOUBLE ELSE 0.5 END)
   - (CASE WHEN len(negative_genres) > 0 THEN 0.5::DOUBLE * len(list_intersect(genres, negative_genres)) / len(negative_genres) ELSE 0 END), 0), 1) AS plot,
  CASE WHEN len(words) > 0 THEN len(list_intersect(words, title_tokens))::DOUBLE / len(list_distinct(list_concat(words, title_tokens))) ELSE 0 END AS lexical,
  greatest(len(list_intersect(genres, liked))::DOUBLE / len(list_distinct(list_concat(genres, liked)))
   - (CASE WHEN len(disliked) > 0 THEN len(list_intersect(genres, disliked))::DOUBLE / len(list_distinct(list_concat(genres, disliked))) ELSE 0 END), 0) AS history,
  list_sum(list_transform(range(1, 9), lambda i: eu[i] * pu[i])) / (list_sum(eu) * list_sum(pu)) AS emotion
  FROM proxy_prompts, proxy_items),
proxied AS (SELECT *, 0.4::DOUBLE * plot + 0.3::DOUBLE * lexical + 0.2::DOUBLE * history + 0.1::DOUBLE * emotion AS combined FROM signals)
"""
_PROXY_TOP = _PROXY + f"""SELECT prompt_id, item_id, combined FROM (SELECT prompt_id, item_id, combined,
  row_number() OVER (PARTITION BY prompt_id ORDER BY combined DESC, item_id) AS rk FROM (
   SELECT prompt_id, item_id, {r('combined')} AS combined FROM proxied) a) b WHERE rk <= {K}"""
_PROXY_OFFERS = _PROXY + f"""SELECT prompt_id, item_id, {', '.join(r(c) + f' AS {c}' for c in ('plot', 'lexical', 'history', 'emotion', 'combined'))}
FROM proxied JOIN (SELECT DISTINCT l_suppkey AS prompt_id, l_partkey AS item_id FROM lineitem) o USING (prompt_id, item_id)"""

QUERIES = {
    "tokens_of_documents": tokens_of_documents,
    "boosted_tokens_of_documents": boosted_tokens_of_documents,
    "bm25_postings": bm25_postings, "bm25_search_own_filters": bm25_search_own_filters, "bm25_search_post_filtered": bm25_search_post_filtered,
    "bm25_term_statistics": bm25_term_statistics,
    "bm25_corpus_statistics": bm25_corpus_statistics,
    "bm25_search": bm25_search,
    "bm25_search_floored_idf": bm25_search_floored_idf,
    "bm25_search_filtered": bm25_search_filtered,
    "dense_search_cosine": _dense("cosine"),
    "dense_search_ip": _dense("ip"),
    "dense_search_l2": _dense("l2"),
    "dense_cells_cosine": _cells("cosine"),
    "dense_cells_ip": _cells("ip"),
    "dense_cells_l2": _cells("l2"),
    "dense_search_filtered": dense_search_filtered,
    "dense_search_post_filtered": dense_search_post_filtered,
    "dense_probe": dense_probe,
    "embedding_dimensions": embedding_dimensions,
    "embedding_norms": embedding_norms,
    "embedding_provenance": embedding_provenance,
    "unit_vectors": unit_vectors,
    "hashed_embeddings": hashed_embeddings,
    "user_item_cosine": user_item_cosine,
    "user_scores_of_candidates": user_scores_of_candidates,
    "user_movie_scores": user_movie_scores,
    "emotion_similarity": emotion_similarity,
    "emotion_columns": emotion_columns,
    "candidate_table": candidate_table,
    "candidate_union": candidate_union,
    "hybrid_rerank": hybrid_rerank,
    "listwise_candidates": listwise_candidates,
    "pooled_scores": pooled_scores,
    "zscore_variants": zscore_variants,
    "fused_by_prompt_weights": fused_by_prompt_weights,
    "dz_summaries": dz_summaries,
    "dominance_gate": dominance_gate,
    "cascade_scores": cascade_scores,
    "cascade_log": cascade_log,
    "fusion_weight_rules": fusion_weight_rules,
    "proxy_top_items": proxy_top_items,
    "proxy_top_items_indexed": proxy_top_items_indexed,
    "proxy_scores_of_offers": proxy_scores_of_offers,
}

_NAMES = [f"score_{e}" for e in EXPERTS] + [f"z_{e}" for e in EXPERTS]
_UV = "(SELECT item_id, u, list_reverse(u) AS w FROM unit_vectors)"
ORACLES = {
    "hashed_embeddings": _HASHED,
    "bm25_search_own_filters": with_ctes("bm25", "chunks") + _BM25_TOP.format(score=r("score"), source=f"bm25 JOIN chunks ON chunk_id = doc_id WHERE {_OWN_FILTERS}", k=K),
    "bm25_search_post_filtered": with_ctes("bm25", "chunks") + f""", first AS ({_BM25_TOP.format(score=r("score"), source="bm25", k=5 * K)}) SELECT query_id, doc_id, score FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM first JOIN chunks ON chunk_id = doc_id WHERE {_OWN_FILTERS}) c WHERE rk <= {K}""",
    "tokens_of_documents": with_ctes("doc_tokens") + "SELECT doc_id AS chunk_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS token_hash FROM doc_tokens",
    "boosted_tokens_of_documents": with_ctes("chunks") + """SELECT chunk_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS token_hash FROM (
      SELECT chunk_id, list_concat(list_concat(list_concat(h, h), regexp_extract_all(lower(text), '[a-z0-9]+')), regexp_extract_all(lower(type), '[a-z0-9]+')) AS t
      FROM (SELECT *, regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:6], ' ')), '[a-z0-9]+') AS h FROM chunks) a) b""",
    "bm25_postings": with_ctes("postings") + "SELECT doc_id, term, tf, dl FROM postings",
    "bm25_term_statistics": with_ctes("term_df", "corpus") + f"SELECT term, df, {r('ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))')} AS idf FROM term_df, corpus",
    "bm25_corpus_statistics": with_ctes("corpus") + f"SELECT n_docs, {r('avgdl')} AS avgdl, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM corpus",
    "bm25_search": with_ctes("bm25") + _BM25_TOP.format(score=r("score"), source="bm25", k=K),
    "bm25_search_floored_idf": with_ctes("postings", "term_df", "corpus", "query_terms") + f", idfs AS ({_IDFS}), scored AS ({_FLOORED}) "
                               + _BM25_TOP.format(score=r("score"), source="scored", k=K),
    "bm25_search_filtered": with_ctes("bm25", "chunks") + _BM25_TOP.format(
        score=r("score"), source=f"(SELECT * FROM bm25 WHERE doc_id IN ({_ALLOWED})) f", k=K),
    "dense_search_cosine": _dense_sql("cosine"),
    "dense_search_ip": _dense_sql("ip"),
    "dense_search_l2": _dense_sql("l2"),
    "dense_cells_cosine": _dense_sql("cosine"),
    "dense_cells_ip": _dense_sql("ip"),
    "dense_cells_l2": _dense_sql("l2"),
    "dense_search_filtered": _dense_sql("cosine", where="WHERE item_id IN (SELECT item_id FROM vectors WHERE label >= 5)"),
    "dense_search_post_filtered": _dense_sql("cosine", post="SELECT item_id FROM vectors WHERE label >= 5"),
    "dense_probe": with_ctes("vectors") + f""", centre AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT pos, avg(vector[pos]) AS x FROM vectors, range(1, 65) t(pos) GROUP BY 1) a)
      SELECT item_id AS query_id, {r('sqrt(list_sum(list_transform(vector, lambda x: x * x)))')} AS query_norm,
      {r('list_sum(list_transform(range(1, 65), lambda i: vector[i] * c[i])) / (sqrt(list_sum(list_transform(vector, lambda x: x * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x))) + 1e-12::DOUBLE)')} AS cosine_to_mean FROM vectors, centre""",
    "embedding_dimensions": "SELECT count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings",
    "embedding_norms": with_ctes("vectors") + f"""SELECT count(*) AS n, 64 AS dim, 'cosine' AS metric, {r('avg(x)')} AS norm_mean, {r('stddev_pop(x)')} AS norm_std, {r('max(x)')} AS norm_max
      FROM (SELECT sqrt(list_sum(list_transform(vector, lambda y: y * y))) AS x FROM vectors) a""",
    "embedding_provenance": "SELECT 'encoder-' || label AS index_model, 'org/encoder-3' AS query_model, count(*) AS n, contains('org/encoder-3', 'encoder-' || label) AS matches FROM embeddings GROUP BY label",
    "unit_vectors": with_ctes("unit_vectors") + f"""SELECT item_id, {r('u[1]')} AS first, {r('sqrt(list_sum(list_transform(u, lambda x: x * x)))')} AS norm,
      {r('list_sum(list_transform(range(1, 65), lambda i: u[i] * w[i]))')} AS mirrored, {r('list_sum(list_transform(range(1, 65), lambda i: (u[i] - w[i]) * (u[i] - w[i])))')} AS distance FROM {_UV} a""",
    "user_item_cosine": with_ctes("unit_vectors", "user_profiles") + f"""SELECT user_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rk FROM (
      SELECT c.user_id, x.item_id, {r('list_sum(list_transform(range(1, 65), lambda i: c.vector[i] * x.u[i])) / (sqrt(list_sum(list_transform(c.vector, lambda y: y * y))) + 1e-12::DOUBLE)')} AS score
      FROM user_profiles c, unit_vectors x) a) b WHERE rk <= 50""",
    "user_scores_of_candidates": with_ctes("vectors", "label_centres") + f"SELECT user_id, item_id, {r('score')} AS score FROM ({_OWN}) a",
    "user_movie_scores": with_ctes("vectors", "label_centres") + f"SELECT user_id, item_id // 4 AS movie_id, {r('max(score)')} AS max_score, {r('sum(score)')} AS sum_score FROM ({_OWN}) a GROUP BY 1, 2",
    "emotion_similarity": with_ctes("queries", "emotions", "vectors") + f"""SELECT c.query_id, c.item_id, {r(js_sql('q.prompt_emo', f'coalesce(e.emo, {UNIFORM})'))} AS js_sqrt,
      {r(f"CASE WHEN e.emo IS NULL THEN 0 ELSE {js_sql('q.prompt_emo', 'e.emo', 'norm')} END")} AS js_norm
      FROM (SELECT query_id, v.item_id FROM queries JOIN vectors v ON v.label = user_id UNION ALL SELECT query_id, query_id + 1000000 FROM queries) c
      JOIN queries q USING (query_id) LEFT JOIN emotions e ON e.item_id = c.item_id""",
    "emotion_columns": with_ctes("emotions") + "SELECT item_id, " + ", ".join(f'{r(f"emo[{i + 1}]")} AS "{e}"' for i, e in enumerate(EMOTIONS)) + " FROM emotions",
    "candidate_table": _table_sql("sum", False, "pop") + "SELECT query_id, item_id, " + ", ".join(f"{r(n)} AS {n}" for n in _NAMES) + " FROM ztable",
    "candidate_union": _UNION,
    "hybrid_rerank": _HYBRID,
    "listwise_candidates": _LISTWISE,
    "pooled_scores": _POOLED,
    "zscore_variants": _ZS,
    "fused_by_prompt_weights": _FUSED,
    "dz_summaries": _DZ,
    "dominance_gate": _GATE,
    "cascade_scores": _CASCADE_SCORES,
    "cascade_log": _CASCADE_LOG,
    "fusion_weight_rules": _WRULES,
    "proxy_top_items": _PROXY_TOP,
    "proxy_top_items_indexed": _PROXY_TOP,
    "proxy_scores_of_offers": _PROXY_OFFERS,
}
