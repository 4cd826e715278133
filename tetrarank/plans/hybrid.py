"""Hybrid retrieval for a batch of queries: four experts, pooling, normalization, fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS
from tetrarank.operators import bm25, collaborative, dense, emotion, postings, scoring
from tetrarank.operators.scale import checkpoint_dir


@dataclass(frozen=True)
class Corpus:
    """Tables a hybrid query reads.

    chunk_map(chunk_id, item_id), chunk_vectors(chunk_id, vector), text index over chunk ids (a posting index, or for
    filtered searches a table of documents),
    user_vectors(user_id, vector), cf_vectors(item_id, vector) with cf_map(item_id, movie_id),
    emotions(item_id, emo).
    """

    chunk_map: DataFrame
    chunk_vectors: DataFrame
    index: bm25.BM25Index | postings.PostingIndex
    user_vectors: DataFrame
    cf_vectors: DataFrame
    cf_map: DataFrame
    emotions: DataFrame


def retrieve(corpus: Corpus, queries: DataFrame, k: int, *, how: str = "sum", use_dense: bool = True,
             temperature: float = 1.0, allowed_chunks: DataFrame | None = None, **rules) -> dict[str, DataFrame]:
    """Item scores of the text experts: alpha (dense) and beta (BM25), each from its k best chunks per query.

    queries: query_id, text, vector. `rules` are filters (a row of conditions per query), meta (chunk_id and the columns that
    conditions look at), filter_mode and oversample, as both searches take them.
    """
    text_rules = {**rules, "meta": rules["meta"].withColumnRenamed("chunk_id", "doc_id")} if rules.get("meta") is not None else rules
    hits = {}
    if use_dense:
        found = dense.search(queries, corpus.chunk_vectors, k, item_id="chunk_id",
                             allowed=allowed_chunks, **rules).withColumnRenamed("item_id", "chunk_id")
        hits["alpha"] = found
    docs = allowed_chunks.withColumnRenamed("chunk_id", "doc_id") if allowed_chunks is not None else None
    if isinstance(corpus.index, postings.PostingIndex):
        if docs is not None or rules:
            raise ValueError("filters need an index of documents (bm25.build_index)")
        found = postings.search(corpus.index, queries, k)
    else:
        found = bm25.search(corpus.index, queries, k, doc_filter=docs, **text_rules)
    hits["beta"] = found.withColumnRenamed("doc_id", "chunk_id")
    return {name: scoring.pool(found.join(corpus.chunk_map, "chunk_id"), ["query_id", "item_id"], how=how,
                               temperature=temperature) for name, found in hits.items()}


def prior(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    """Movie scores of each query's user: the k best items of the user's row, mapped by maximum."""
    users = corpus.user_vectors.join(queries.select("user_id").distinct(), "user_id", "left_semi")
    per_user = collaborative.to_movies(collaborative.user_top_items(users, corpus.cf_vectors, k), corpus.cf_map)
    return queries.select("query_id", "user_id").join(per_user, "user_id").select(
        "query_id", F.col("movie_id").alias("item_id"), "score")


def candidate_prior(corpus: Corpus, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """gamma for given (query_id, item_id) rows: best cosine over the collaborative items of the movie."""
    asked = candidates.select("query_id", "item_id").join(queries.select("query_id", "user_id"), "query_id")
    mapped = asked.select("query_id", "user_id", F.col("item_id").alias("movie_id")).join(corpus.cf_map, "movie_id")
    scored = collaborative.candidate_scores(mapped, corpus.user_vectors, corpus.cf_vectors)
    return scored.groupBy("query_id", F.col("movie_id").alias("item_id")).agg(F.max("score").alias("score"))


def expert_table(corpus: Corpus, queries: DataFrame, k: int, *, how: str = "sum", prior_k: int = 0,
                 use_dense: bool = True, zmode: str = "pop", temperature: float = 1.0,
                 allowed_chunks: DataFrame | None = None, **rules) -> DataFrame:
    """query_id, item_id, score_* and z_* for the union of the experts' candidates.

    Candidates are the dense and BM25 items and, with prior_k, the best items of the query's user.
    gamma and delta are computed for exactly these candidates.
    """
    text_scores = retrieve(corpus, queries, k, how=how, use_dense=use_dense, temperature=temperature,
                           allowed_chunks=allowed_chunks, **rules)
    frames = dict(text_scores)
    if prior_k:
        frames["__prior"] = prior(corpus, queries, prior_k)
    joined = scoring.outer_union(frames, ["query_id", "item_id"])
    found = {e: F.col(e) if e in frames else F.lit(0.0) for e in ("alpha", "beta")}
    # The candidate lists feed gamma, the join and both passes of the z-scores: stored, they are retrieved once.
    checkpoint_dir(queries.sparkSession)
    base = joined.select("query_id", "item_id", *[c.alias(f"score_{e}") for e, c in found.items()]).checkpoint()
    gamma = candidate_prior(corpus, base, queries).withColumnRenamed("score", "score_gamma")
    with_gamma = base.join(gamma, ["query_id", "item_id"], "left").withColumn(
        "score_gamma", F.coalesce("score_gamma", F.lit(0.0)))
    vectors = queries.select("query_id", F.col("prompt_emo").alias("emo"))
    complete = emotion.similarity_scores(with_gamma, vectors, corpus.emotions, score="score_delta")
    return scoring.zscores(complete, ["query_id"], {f"score_{e}": f"z_{e}" for e in EXPERTS}, zmode)


def hybrid_rerank(corpus: Corpus, queries: DataFrame, weights: dict[str, float], k: int, top_m: int, *,
                  how: str = "sum", prior_k: int = 50, meta: DataFrame | None = None,
                  allowed_chunks: DataFrame | None = None, **rules) -> DataFrame:
    """Final top_m items per query with contributions of each expert. A zero alpha skips the dense branch."""
    w = scoring.normalize_weights(weights)
    table = expert_table(corpus, queries, k, how=how, prior_k=prior_k, use_dense=w.get("alpha", 0.0) > 0.0,
                         zmode="clip_sample", allowed_chunks=allowed_chunks, **rules)
    return scoring.final_top(scoring.fuse(table, w), top_m, meta=meta)


def score_given_candidates(corpus: Corpus, candidates: DataFrame, queries: DataFrame, k: int, how: str = "sum") -> DataFrame:
    """Four expert scores for given (query_id, item_id) rows; 0 where an expert did not retrieve the item."""
    text_scores = retrieve(corpus, queries, k, how=how)
    base = candidates
    for e in ("alpha", "beta"):
        base = base.join(text_scores[e].withColumnRenamed("score", f"score_{e}"), ["query_id", "item_id"], "left")
    gamma = candidate_prior(corpus, candidates, queries).withColumnRenamed("score", "score_gamma")
    base = base.join(gamma, ["query_id", "item_id"], "left").na.fill(0.0, ["score_alpha", "score_beta", "score_gamma"])
    vectors = queries.select("query_id", F.col("prompt_emo").alias("emo"))
    return emotion.similarity_scores(base, vectors, corpus.emotions, mode="norm", score="score_delta")
