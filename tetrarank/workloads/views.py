"""Role tables derived from the given tables, for Spark and as SQL common table expressions.

Roles: pairs (order lines as preference pairs), ranking (a customer's parts as a graded list), chunks and
movies (documents, four to a movie), vectors, emotion profiles, prompts, users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS
from tetrarank.functions import distributions as dx
from tetrarank.functions import numeric as nx
from tetrarank.functions import text as tx
from tetrarank.functions import vectors as vx
from tetrarank.operators import dense


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL helpers ------------------------------------------------------------------------------------

def r(expression: str, digits: int = 6) -> str:
    """Rounded value without negative zero."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def uniform(*parts: str, seed: str = "42") -> str:
    return f"(('0x' || substr({hashed(*parts, seed=seed)}, 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def hashed(*parts: str, seed: str = "42") -> str:
    joined = ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"md5(concat_ws('|', {joined}))"


def with_ctes(*names: str) -> str:
    """WITH clause of the named role tables and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        text = CTES[name]
        for other in CTES:
            if other != name and f" {other} " in f" {text.replace('(', ' ').replace(')', ' ').replace(chr(10), ' ')} " \
                    and other not in order:
                add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n"


# --- pairs ------------------------------------------------------------------------------------------

def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as preference pairs; y follows the differences plus hash noise."""
    li = table(spark, sf, "lineitem")
    pair_id = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                          F.col("l_quantity").cast("long"))
    base = li.select(
        F.col("l_orderkey").alias("prompt_id"), pair_id.alias("pair_id"), F.col("l_partkey").alias("movieA"),
        F.col("l_suppkey").alias("movieB"),
        ((F.col("l_discount") - F.lit(0.05)) * F.lit(20.0)).alias("dz_alpha"),
        ((F.col("l_quantity") - F.lit(25.0)) / F.lit(25.0)).alias("dz_beta"),
        ((F.col("l_tax") - F.lit(0.04)) * F.lit(25.0)).alias("dz_gamma"),
        ((F.col("l_extendedprice") - F.lit(40000.0)) / F.lit(37123.0)).alias("dz_delta"),
        F.col("l_returnflag").alias("category"),
        F.when(F.col("l_linenumber") % 3 == 0, "easy").when(F.col("l_linenumber") % 3 == 1, "medium")
        .otherwise("hard").alias("difficulty"))
    lean = (F.lit(0.4) * F.col("dz_alpha") + F.lit(0.3) * F.col("dz_beta") + F.lit(0.2) * F.col("dz_gamma")
            + F.lit(0.1) * F.col("dz_delta") + (nx.hash_uniform(F.col("pair_id"), seed="y") - F.lit(0.5)))
    return base.withColumn("y", F.when(lean > 0, 1).otherwise(0))


PAIRS = f"""
SELECT *, CASE WHEN 0.4::DOUBLE * dz_alpha + 0.3::DOUBLE * dz_beta + 0.2::DOUBLE * dz_gamma
    + 0.1::DOUBLE * dz_delta + ({uniform('pair_id', seed='y')} - 0.5::DOUBLE) > 0 THEN 1 ELSE 0 END AS y
FROM (SELECT l_orderkey AS prompt_id,
        concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS pair_id,
        l_partkey AS "movieA", l_suppkey AS "movieB",
        (l_discount - 0.05::DOUBLE) * 20.0::DOUBLE AS dz_alpha, (l_quantity - 25.0::DOUBLE) / 25.0::DOUBLE AS dz_beta,
        (l_tax - 0.04::DOUBLE) * 25.0::DOUBLE AS dz_gamma, (l_extendedprice - 40000.0::DOUBLE) / 37123.0::DOUBLE AS dz_delta,
        l_returnflag AS category,
        CASE l_linenumber % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty
      FROM lineitem) base"""


def margin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with a fixed-weight margin."""
    return pairs(spark, sf).withColumn("margin", nx.weighted_margin(
        [F.lit(0.4), F.lit(0.3), F.lit(0.2), F.lit(0.1)], [F.col(f"dz_{e}") for e in EXPERTS]))


MARGIN_PAIRS = """
SELECT *, 0.4::DOUBLE * dz_alpha + 0.3::DOUBLE * dz_beta + 0.2::DOUBLE * dz_gamma + 0.1::DOUBLE * dz_delta AS margin
FROM pairs """


def peaked(spark_column: F.Column, seed: str) -> list:
    """Four hash numbers to the sixth power: often one of them dominates."""
    return [F.pow(nx.hash_uniform(spark_column, F.lit(e), seed=seed), F.lit(6.0)) for e in EXPERTS]


def _with_normalized(rows: DataFrame, raw: list, prefix: str) -> DataFrame:
    """Adds the four numbers divided by their sum. They are generated, so each is made once per row and not at every use."""
    made = rows.select("*", F.explode(F.array(F.struct(*[x.alias(e) for x, e in zip(raw, EXPERTS)]))).alias("__raw"))
    raw = [F.col("__raw")[e] for e in EXPERTS]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    return made.select(*rows.columns, *[(x / total).alias(f"{prefix}{e}") for x, e in zip(raw, EXPERTS)])


def weighted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with per-pair expert weights w_* and the margin these weights give."""
    rows = pairs(spark, sf)
    rows = _with_normalized(rows, peaked(F.col("pair_id"), "w"), "w_")
    return rows.withColumn("margin", nx.weighted_margin(
        [F.col(f"w_{e}") for e in EXPERTS], [F.col(f"dz_{e}") for e in EXPERTS]))


def _sql_weights(key: str, seed: str, prefix: str) -> str:
    raws = ", ".join(f"pow({uniform(key, repr(e), seed=seed)}, 6.0::DOUBLE) AS raw_{e}" for e in EXPERTS)
    total = " + ".join(f"raw_{e}" for e in EXPERTS)
    return raws, ", ".join(f"raw_{e} / ({total}) AS {prefix}{e}" for e in EXPERTS)


_RAW, _NORMED = _sql_weights("pair_id", "w", "w_")
WEIGHTED_PAIRS = f"""
SELECT *, w_alpha * dz_alpha + w_beta * dz_beta + w_gamma * dz_gamma + w_delta * dz_delta AS margin FROM (
  SELECT * EXCLUDE (raw_alpha, raw_beta, raw_gamma, raw_delta), {_NORMED}
  FROM (SELECT *, {_RAW} FROM pairs ) a) b"""


# --- graded lists -----------------------------------------------------------------------------------

def ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's parts as a list: relevance from the quantity, four signals from the order lines."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("prompt_id"), F.col("l_partkey").alias("item_id")).agg(
        F.least(F.sum("l_quantity") / F.lit(50.0), F.lit(1.0)).alias("gt_score"),
        (F.max("l_discount") * F.lit(10.0)).alias("score_alpha"),
        (F.max("l_extendedprice") / F.lit(99991.0)).alias("score_beta"),
        (F.max("l_tax") * F.lit(12.5)).alias("score_gamma"),
        (F.min("l_quantity") / F.lit(50.0)).alias("score_delta"))


RANKING = """
SELECT o_custkey AS prompt_id, l_partkey AS item_id, least(sum(l_quantity) / 50.0::DOUBLE, 1.0::DOUBLE) AS gt_score,
       max(l_discount) * 10.0::DOUBLE AS score_alpha, max(l_extendedprice) / 99991.0::DOUBLE AS score_beta,
       max(l_tax) * 12.5::DOUBLE AS score_gamma, min(l_quantity) / 50.0::DOUBLE AS score_delta
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def ranking_with_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Lists with signals named z_* and per-prompt mixtures mix_*."""
    rows = ranking(spark, sf).withColumnsRenamed({f"score_{e}": f"z_{e}" for e in EXPERTS})
    return _with_normalized(rows, peaked(F.col("prompt_id"), "mix"), "mix_")


_RAW2, _NORMED2 = _sql_weights("prompt_id", "mix", "mix_")
WEIGHTED_RANKING = f"""
SELECT * EXCLUDE (raw_alpha, raw_beta, raw_gamma, raw_delta), {_NORMED2} FROM (
  SELECT prompt_id, item_id, gt_score, score_alpha AS z_alpha, score_beta AS z_beta, score_gamma AS z_gamma,
         score_delta AS z_delta, {_RAW2} FROM ranking ) a"""


def prompt_weights(spark: SparkSession, sf: str) -> DataFrame:
    """w_* for every customer."""
    return _with_normalized(table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt_id")), peaked(F.col("prompt_id"), "mix"), "w_")


_RAW3, _NORMED3 = _sql_weights("c_custkey", "mix", "w_")
PROMPT_WEIGHTS = f"""
SELECT c_custkey AS prompt_id, {_NORMED3} FROM (SELECT c_custkey, {_RAW3} FROM customer) a"""


# --- text, vectors, emotions ------------------------------------------------------------------------

def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks; four consecutive documents make a movie."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("movie_id"), "text",
        F.col("lang").alias("original_language"), F.col("source").alias("type"))


CHUNKS = """
SELECT doc_id AS chunk_id, doc_id // 4 AS movie_id, text, lang AS original_language, source AS type FROM documents"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


VECTORS = "SELECT vec_id AS item_id, embedding::DOUBLE[] AS vector, label FROM embeddings"


def emotions(spark: SparkSession, sf: str) -> DataFrame:
    """Eight vector entries as an emotion profile."""
    return vectors(spark, sf).select("item_id", dx.smoothed_simplex(F.slice("vector", 1, 8)).alias("emo"))


EMOTIONS = """
SELECT item_id, list_transform(raised, lambda x: x / list_sum(raised)) AS emo FROM (
  SELECT item_id, list_transform(vector[1:8], lambda x: greatest(x, 0.0::DOUBLE) + 1e-9::DOUBLE) AS raised FROM vectors ) a"""


def label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label: the user vectors."""
    return dense.mean_vector(vectors(spark, sf), by=["label"]).select(F.col("label").cast("long").alias("user_id"), "vector")


def user_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A few items each, by number: the mean vector of a user's items."""
    return dense.mean_vector(vectors(spark, sf).withColumn("user_id", (F.col("item_id") % 250).cast("long")), by=["user_id"])


USER_PROFILES = """
SELECT user_id, list(x ORDER BY pos) AS vector FROM (
  SELECT (item_id % 250)::BIGINT AS user_id, pos, avg(vector[pos]) AS x
  FROM vectors , range(1, 65) t(pos) GROUP BY 1, 2) a GROUP BY 1"""


LABEL_CENTRES = """
SELECT user_id, list(x ORDER BY pos) AS vector FROM (
  SELECT label::BIGINT AS user_id, pos, avg(vector[pos]) AS x
  FROM vectors , range(1, 65) t(pos) GROUP BY 1, 2) a GROUP BY 1"""


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as queries: text, vector of the same id, user, emotion profile."""
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    v = vectors(spark, sf).select(F.col("item_id").alias("query_id"), "vector", F.col("label").cast("long").alias("user_id"),
                                  dx.smoothed_simplex(F.slice("vector", 9, 8)).alias("prompt_emo"))
    return bench.join(v, "query_id")


QUERIES = """
SELECT query_id, text, vector, user_id, list_transform(raised, lambda x: x / list_sum(raised)) AS prompt_emo FROM (
  SELECT b.item_id AS query_id, b.text, v.vector, v.label::BIGINT AS user_id,
         list_transform(v.vector[9:16], lambda x: greatest(x, 0.0::DOUBLE) + 1e-9::DOUBLE) AS raised
  FROM benchmark b JOIN vectors v ON b.item_id = v.item_id) a"""


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns of conversations as prompts."""
    return table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), F.col("text"))


USER_TURNS = "SELECT concat_ws('-', conv_id, turn) AS prompt_id, text FROM conversations WHERE role = 'user'"

# Token counts per document and query, corpus statistics and BM25 scores.
CTES = {
    "pairs": PAIRS, "margin_pairs": MARGIN_PAIRS, "weighted_pairs": WEIGHTED_PAIRS, "ranking": RANKING,
    "weighted_ranking": WEIGHTED_RANKING, "prompt_weights": PROMPT_WEIGHTS, "chunks": CHUNKS, "vectors": VECTORS,
    "emotions": EMOTIONS, "label_centres": LABEL_CENTRES, "user_profiles": USER_PROFILES, "queries": QUERIES, "user_turns": USER_TURNS,
    "doc_tokens": "SELECT chunk_id AS doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM chunks ",
    "postings": "SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, "
                "unnest(toks) AS term FROM doc_tokens ) a GROUP BY 1, 2",
    "corpus": "SELECT count(*) AS n_docs, avg(greatest(len(toks), 1)) AS avgdl FROM doc_tokens ",
    "term_df": "SELECT term, count(*) AS df FROM postings GROUP BY 1",
    "query_terms": "SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, "
                   "unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) a GROUP BY 1, 2",
    "bm25": "SELECT query_id, doc_id, sum(qtf * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE "
            "/ (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score "
            "FROM query_terms JOIN postings USING (term) JOIN term_df USING (term) , corpus GROUP BY 1, 2",
    "unit_vectors": "SELECT item_id, list_transform(vector, lambda x: x / (sqrt(list_sum(list_transform(vector, "
                    "lambda y: y * y))) + 1e-12::DOUBLE)) AS u FROM vectors ",
}
