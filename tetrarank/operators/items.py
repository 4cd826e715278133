"""Item tables: filters, metadata, chunk building, text maps, corpus summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import ITEM_META
from tetrarank.functions import text as tx
from tetrarank.operators.scale import exact_quantiles, first_row, top_k


def metadata_filter(columns: list[str], *, language=None, year_gte: int | None = None, year_lte: int | None = None,
                    adult: bool | None = None, kind=None) -> Column:
    """Conjunction of the given conditions; conditions on absent columns pass, unreadable dates fail."""
    def as_list(v):
        return [v] if isinstance(v, str) else list(v)

    terms = []
    if language is not None and "original_language" in columns:
        terms.append(F.col("original_language").isin(as_list(language)))
    if "release_date" in columns:
        year = F.year(F.col("release_date").cast("string").try_cast("date"))
        if year_gte is not None:
            terms.append(year >= int(year_gte))
        if year_lte is not None:
            terms.append(year <= int(year_lte))
    if adult is not None and "adult" in columns:
        terms.append(F.col("adult") == F.lit(bool(adult)))
    if kind is not None and "type" in columns:
        terms.append(F.col("type").isin(as_list(kind)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


#: Columns of a table of filters, one row per query; null means no condition.
FILTERS = {"f_language": "array<string>", "f_year_gte": "int", "f_year_lte": "int", "f_adult": "boolean", "f_kind": "array<string>"}
_META = {"original_language": "string", "release_date": "string", "adult": "boolean", "type": "string"}


def _conditions(filters: DataFrame, query_id: str) -> DataFrame:
    """One row per query with all columns of FILTERS; those that are absent are null."""
    return filters.select(F.col(query_id).alias("__q"), *[
        (F.col(c) if c in filters.columns else F.lit(None)).cast(t).alias(c) for c, t in FILTERS.items()])


def _described(meta: DataFrame, item_id: str) -> DataFrame:
    """What conditions look at, one row per item; a condition on a column that `meta` lacks passes."""
    year = F.year(F.col("release_date").cast("string").try_cast("date")) if "release_date" in meta.columns else F.lit(None)
    columns = [F.col(c).cast(t) if c in meta.columns else F.lit(None).cast(t) for c, t in _META.items() if c != "release_date"]
    rows = meta.select(F.col(item_id).alias("__i"), year.cast("int").alias("m_year"), *[c.alias(n) for c, n in zip(columns, ("m_language", "m_adult", "m_kind"))])
    return first_row(rows, ["__i"], [F.col("m_year"), F.col("m_language"), F.col("m_kind")])


def _checked(meta: DataFrame) -> dict[str, bool]:
    return {"language": "original_language" in meta.columns, "year": "release_date" in meta.columns, "adult": "adult" in meta.columns,
            "kind": "type" in meta.columns}


def passing(hits: DataFrame, filters: DataFrame, meta: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """Hits whose item meets the conditions of their query; queries without a row of conditions keep all their hits."""
    has, c = _checked(meta), F.col
    joined = hits.join(_conditions(filters, query_id), c(query_id) == c("__q"), "left").join(_described(meta, item_id), c(item_id) == c("__i"), "left")
    terms = {"language": c("f_language").isNull() | F.array_contains("f_language", c("m_language")),
             "year": (c("f_year_gte").isNull() | (c("m_year") >= c("f_year_gte"))) & (c("f_year_lte").isNull() | (c("m_year") <= c("f_year_lte"))),
             "adult": c("f_adult").isNull() | (c("m_adult") == c("f_adult")), "kind": c("f_kind").isNull() | F.array_contains("f_kind", c("m_kind"))}
    return joined.where(reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for n, t in terms.items() if has[n]], F.lit(True))).select(*hits.columns)


def with_filters(queries: DataFrame, items: DataFrame, filters: DataFrame, meta: DataFrame, query_id: str, item_id: str):
    """(queries, items, keep) for a block search that drops pairs before the cut, each query by its own conditions."""
    has = _checked(meta)
    asked = queries.join(_conditions(filters, query_id), F.col(query_id) == F.col("__q"), "left").drop("__q")
    described = items.join(_described(meta, item_id), F.col(item_id) == F.col("__i"), "left").drop("__i")

    def keep(q: pa.Table, i: pa.Table) -> np.ndarray:
        out = np.ones((q.num_rows, i.num_rows), bool)

        def column(t: pa.Table, name: str) -> list:
            return t.column(name).to_pylist()

        for name, listed, found in (("language", "f_language", "m_language"), ("kind", "f_kind", "m_kind")):
            if has[name]:
                code = {x: k for k, x in enumerate(sorted({x for x in column(i, found) if x is not None}))}
                own = np.array([code.get(x, len(code)) for x in column(i, found)])
                for row, allowed in enumerate(column(q, listed)):
                    if allowed is not None:
                        wanted = np.zeros(len(code) + 1, bool)
                        wanted[[code[x] for x in allowed if x in code]] = True
                        out[row] &= wanted[own]
        if has["year"]:
            year = np.array([np.nan if y is None else y for y in column(i, "m_year")], np.float64)
            for bound, better in (("f_year_gte", np.greater_equal), ("f_year_lte", np.less_equal)):
                for row, y in enumerate(column(q, bound)):
                    if y is not None:
                        out[row] &= better(year, y)
        if has["adult"]:
            adult = np.array([-1 if x is None else int(x) for x in column(i, "m_adult")])
            for row, x in enumerate(column(q, "f_adult")):
                if x is not None:
                    out[row] &= adult == int(x)
        return out

    return asked, described, keep


def filter_items(items: DataFrame, **conditions) -> DataFrame:
    return items.where(metadata_filter(items.columns, **conditions))


def filter_scores(scores: DataFrame, items: DataFrame, item_id: str, **conditions) -> DataFrame:
    """Scores whose item passes the filter; one metadata row per item is enough, so a semi join does it."""
    return scores.join(filter_items(items, **conditions).select(item_id), item_id, "left_semi")


def known_meta(items: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The metadata columns that the table has."""
    return items.select(*[c for c in [*ITEM_META, *(extra or [])] if c in items.columns])


def pick_column(columns: list[str], candidates: list[str]) -> str:
    """First candidate present."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {candidates} in {columns}")


def with_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns taken from the first alias present; other columns are dropped."""
    return df.select(*[F.col(pick_column(df.columns, names)).alias(target) for target, names in aliases.items()])


def prompt_map(prompts: DataFrame) -> DataFrame:
    """Distinct (prompt_id, text) without nulls, whatever the columns are called."""
    from tetrarank.constants import PROMPT_TEXT_KEYS
    named = with_alias(prompts, {"prompt_id": ["prompt_id", "id"], "text": PROMPT_TEXT_KEYS})
    return named.dropna().distinct()


def movie_text_map(items: DataFrame, item_id: str, text_columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """One joined text per item; of several rows per id the first in the given order."""
    joined = F.array_join(F.array(*[tx.or_empty(F.col(c).cast("string")) for c in text_columns]), " ")
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("movie_id"), joined.alias("movie_text"))
    return first_row(rows, ["movie_id"], order or [F.col("movie_text")])


def build_chunks(items: DataFrame, item_id: str = "movieId", overview: str = "overview", plot: str = "plot",
                 min_words: int = 0) -> DataFrame:
    """One chunk per item from its cleaned overview and plot; items without text or words are left out."""
    carried = [c for c in items.columns if c not in (overview, plot)]
    combined = tx.combined_chunk_text(F.col(overview), F.col(plot))
    # Generating text and word count keeps them one value per row; as plain columns every use would
    # clean the text again. Cleaned text holds no white space but blanks and line breaks.
    made = F.transform(F.array(combined), lambda t: F.struct(
        t.alias("text"), F.regexp_count(t, F.lit("[^ \n]+")).alias("n_words")))
    kept = F.filter(made, lambda s: (s["text"] != "") & (s["n_words"] >= min_words))
    return (items.select(*carried, F.explode(kept).alias("__c")).select(*carried, "__c.*")
            .select("*", F.col(item_id).cast("string").alias("chunkId"), F.length("text").alias("n_chars"),
                    tx.rounded_token_estimate(F.col("text")).alias("n_tokens")))


def chunk_summary(chunks: DataFrame, n_words: str = "n_words") -> DataFrame:
    """One row: chunks, mean, median, max and min words."""
    base = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.avg(n_words).alias("avg_words"),
                      F.max(n_words).alias("max_words"), F.min(n_words).alias("min_words"))
    median = exact_quantiles(chunks.withColumn("__w", F.col(n_words).cast("double")), [], "__w",
                             {"median_words": 0.5}, resolution=1.0)
    return base.select("*", median.scalar().alias("median_words"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value, most frequent first, ties by value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(top) if top else counted


def year_range(df: DataFrame, date: str) -> DataFrame:
    year = F.year(F.col(date).cast("string").try_cast("date"))
    return df.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.avg(year).alias("mean_year"))


def pending_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose output column is still blank."""
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) == "")


def with_history(candidates: DataFrame, ratings: DataFrame, item_id: str = "item_id", user_id: str = "user_id") -> DataFrame:
    """Candidates of many users with each user's own rating of the item, null where not rated."""
    best = ratings.groupBy(F.col("user_id").alias("__user"), F.col("item_id").alias("__item")).agg(F.max("rating").alias("user_rating"))
    same = (F.col(user_id) == F.col("__user")) & (F.col(item_id) == F.col("__item"))
    return candidates.join(best, same, "left").drop("__user", "__item")


def incomplete_prompts(prompts: DataFrame, results: DataFrame, minimum: int, key: str = "prompt_id") -> DataFrame:
    """Prompts with fewer than `minimum` results, with the number found."""
    found = results.groupBy(key).agg(F.count(F.lit(1)).alias("n_results"))
    return (prompts.select(key).distinct().join(found, key, "left")
            .select(key, F.coalesce("n_results", F.lit(0)).alias("n_results")).where(F.col("n_results") < minimum))


def best_k_lists(rows: DataFrame, k: int, by: str = "prompt_id", score: str = "score", item_id: str = "movieId") -> DataFrame:
    """Best k rows per prompt with 0-based rank."""
    ranked = top_k(rows, [by], [F.desc(score), F.col(item_id)], k, rank="rank")
    return ranked.withColumn("rank", F.col("rank") - 1)


#: Items of a pool: a share of the list, and no fewer than the floor.
POOL_FLOOR, POOL_SHARE = 50, 10


def score_pools(scored: DataFrame, by: str, score: str, item_id: str, floor: int = POOL_FLOOR, share: int = POOL_SHARE,
                resolution: float = 256.0) -> DataFrame:
    """Adds rank, n and is_top, is_low, is_mid: the best and the worst max(floor, n / share) items of each
    prompt and those between. In a short list an item can be in the top and in the low pool."""
    from tetrarank.operators.scale import value_rank, with_group_stats
    ranked = value_rank(scored, [by], score, [item_id], "rank", resolution)
    sized = with_group_stats(ranked, [by], [F.count(F.lit(1)).alias("n")])
    size = F.greatest(F.lit(floor), F.floor(F.col("n") / share))
    return sized.withColumns({"is_top": F.col("rank") <= size, "is_low": F.col("rank") > F.col("n") - size,
                              "is_mid": (F.col("rank") > size) & (F.col("rank") <= F.col("n") - size)})
