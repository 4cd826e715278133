"""Emotion profiles: index building, prompt vectors, similarity scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import EMOTIONS
from tetrarank.functions import coerce as co
from tetrarank.functions import distributions as dx
from tetrarank.functions import text as tx


def labelled_scores(records: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """Unfold the accepted record shapes into (record_id, emotion, value, shape) rows.

    Shapes: flat columns named like emotions; a map in `emotions` or `scores`; a list of label/score
    structs in either; a single `label` / `top_emotion` / `emotion` with an optional confidence.
    """
    entries = []
    for name in fields:
        if name.lower() in [e.lower() for e in EMOTIONS] and name != record_id:
            entries.append(_entries(F.array(F.struct(F.lit(name).alias("label"),
                                                     F.col(f"`{name}`").cast("string").alias("value"))), 0))
    for name in ("emotions", "scores"):
        if name in fields:
            entries.append(_json_entries(F.col(name)))
    single = [c for c in ("label", "top_emotion", "emotion") if c in fields]
    if single:
        confidence = [F.col(c).cast("string") for c in ("confidence", "score", "prob", "p") if c in fields]
        value = F.coalesce(*confidence, F.lit("1.0")) if confidence else F.lit("1.0")
        label = F.coalesce(*[F.col(c) for c in single])
        entries.append(_entries(F.array(F.struct(label.alias("label"), value.alias("value"))), 2))
    empty = F.array().cast("array<struct<label:string,value:string,shape:int>>")
    unfolded = records.select(F.col(record_id), F.explode(F.concat(*[F.coalesce(e, empty) for e in entries])).alias("e"))
    return unfolded.select(record_id, co.canonical_emotion(F.col("e.label")).alias("emotion"),
                           F.coalesce(F.col("e.value").try_cast("double"),
                                      F.when(F.col("e.shape") == 2, 1.0)).alias("value"),
                           F.col("e.shape").alias("shape")).where("emotion is not null and value is not null")


def _entries(pairs: Column, shape: int) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"),
                                                 F.lit(shape).alias("shape")))


def _json_entries(text: Column) -> Column:
    """JSON map or JSON list of {label|name|emotion, score|value|prob|p}."""
    as_map = F.from_json(text, "map<string,string>")
    from_map = F.transform(F.map_entries(as_map), lambda kv: F.struct(kv["key"].alias("label"),
                                                                      kv["value"].alias("value")))
    fields = "label string, name string, emotion string, score string, value string, prob string, p string"
    as_list = F.from_json(text, f"array<struct<{fields.replace(' string', ':string')}>>")
    from_list = F.transform(as_list, lambda s: F.struct(
        F.coalesce(s["label"], s["name"], s["emotion"]).alias("label"),
        F.coalesce(s["score"], s["value"], s["prob"], s["p"]).alias("value")))
    return _entries(F.when(F.ltrim(text).startswith("["), from_list).otherwise(from_map), 1)


def emotion_vectors(scores: DataFrame, record_id: str, epsilon: float = 1e-9) -> DataFrame:
    """record_id, emo (eight smoothed probabilities). Nested values win over flat ones, and a single
    label counts only when nothing else is given."""
    # Later shapes override flat columns; shape 2 is a fallback.
    ranked = scores.withColumn("rank", F.when(F.col("shape") == 1, 0).when(F.col("shape") == 0, 1).otherwise(2))
    per_emotion = ranked.groupBy(record_id, "emotion").agg(
        F.min_by("value", F.struct("rank", -F.col("value"))).alias("value"), F.min("rank").alias("rank"))
    wide = per_emotion.groupBy(record_id).agg(
        F.min("rank").alias("best"),
        *[F.max(F.when((F.col("emotion") == e) & (F.col("rank") < 2), F.col("value"))).alias(f"m_{e}")
          for e in EMOTIONS],
        *[F.max(F.when((F.col("emotion") == e) & (F.col("rank") == 2), F.col("value"))).alias(f"s_{e}")
          for e in EMOTIONS])
    raw = F.array(*[F.coalesce(F.when(F.col("best") < 2, F.col(f"m_{e}")).otherwise(F.col(f"s_{e}")), F.lit(0.0))
                    for e in EMOTIONS])
    return wide.select(record_id, dx.smoothed_simplex(raw, epsilon).alias("emo"))


def merge_duplicates(records: DataFrame, key: str, how: str = "max", title: str | None = "title") -> DataFrame:
    """One row per key: mean or max of each emotion renormalized, and the most common title (ties: smallest)."""
    aggregate = {"max": F.max, "mean": F.avg}[how]
    merged = records.groupBy(key).agg(*[aggregate(F.col("emo")[i]).alias(f"e{i}") for i in range(len(EMOTIONS))])
    merged = merged.select(key, dx.simplex(F.array(*[F.col(f"e{i}") for i in range(len(EMOTIONS))])).alias("emo"))
    if title is None:
        return merged
    return merged.join(most_common(records, key, title), key, "left")


def most_common(rows: DataFrame, key: str, value: str) -> DataFrame:
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def named_columns(rows: DataFrame, emo: str = "emo") -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != emo],
                       *[F.col(emo)[i].alias(e) for i, e in enumerate(EMOTIONS)])


def index_from_columns(rows: DataFrame, key: str) -> DataFrame:
    """key, emo from eight named columns, clipped and row-normalized; missing columns are an error."""
    missing = [e for e in EMOTIONS if e not in rows.columns]
    if missing:
        raise KeyError(f"missing emotion columns: {missing}")
    return rows.select(key, dx.simplex(F.array(*[F.col(e) for e in EMOTIONS])).alias("emo"))


def prompt_vectors(prompts: DataFrame, text: str, spec: str | None = None, model: str | None = None) -> DataFrame:
    """Adds prompt_emo and emo_source: the explicit specification first, then a model's prediction column,
    then the keyword lexicon."""
    explicit = co.emotion_from_spec(F.col(spec)) if spec else F.lit(None).cast("array<double>")
    given = F.coalesce(F.trim(F.col(spec)), F.lit("")) != "" if spec else F.lit(False)
    predicted = F.col(model) if model else F.lit(None).cast("array<double>")
    lexicon = tx.lexicon_vector(F.col(text))
    source = (F.when(given, F.lit("prompt")).when(predicted.isNotNull(), F.lit("model")).otherwise(F.lit("lexicon")))
    vector = F.when(given, F.coalesce(explicit, lexicon)).otherwise(F.coalesce(predicted, lexicon))
    return prompts.withColumn("prompt_emo", dx.simplex(vector)).withColumn("emo_source", source)


def similarity_scores(candidates: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, *,
                      query_id: str = "query_id", item_id: str = "item_id", mode: str = "sqrt",
                      score: str = "score") -> DataFrame:
    """Jensen-Shannon similarity for given (query, item) rows.

    Items without a profile count as uniform in `sqrt` mode and score 0 in `norm` mode.
    """
    q = query_vectors.select(query_id, F.col("emo").alias("__q"))
    i = item_vectors.select(item_id, F.col("emo").alias("__i"))
    joined = candidates.join(q, query_id, "left").join(i, item_id, "left")
    query_emo = F.coalesce(F.col("__q"), dx.uniform())
    if mode == "sqrt":
        value = dx.js_similarity(query_emo, F.coalesce(F.col("__i"), dx.uniform()), "sqrt")
    else:
        value = F.when(F.col("__i").isNull(), 0.0).otherwise(dx.js_similarity(query_emo, F.col("__i"), "norm"))
    return joined.withColumn(score, value).drop("__q", "__i")
