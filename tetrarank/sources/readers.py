"""Files to DataFrames.

JSON lines, CSV, TSV and parquet are split between tasks, and so is a JSON document that is one list or one object: up to
WHOLE_FILE_BYTES a file goes to one task, a larger one is cut at its members by byte ranges (`json_split`). The rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrarank.constants import EMOTIONS, GENRE_EMOTIONS, GENRE_PRIOR, ID_KEYS, TITLE_KEYS
from tetrarank.functions import coerce as co
from tetrarank.functions import text as tx
from tetrarank.operators import emotion as em
from tetrarank.sources import json_split

RATINGS = "user_id BIGINT, item_id BIGINT, rating INT, ts BIGINT"

# Genre flags of the item file, in column order.
GENRE_FLAGS = ["unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama",
               "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western"]
ITEM_LINE = T.StructType([T.StructField("movie_id", T.LongType()), T.StructField("title", T.StringType()),
                          T.StructField("release_date", T.StringType()), T.StructField("video_date", T.StringType()),
                          T.StructField("url", T.StringType()),
                          *[T.StructField(f"g{i}", T.IntegerType()) for i in range(len(GENRE_FLAGS))]])

MIX = "struct<alpha:double,beta:double,gamma:double,delta:double>"
CONTEXT = ("struct<length_words:int,length_bucket:string,has_negation:boolean,has_year:boolean,"
           "has_genre_terms:boolean,num_genre_terms:int,persona_style:string,multi_intent:boolean,cold_user:boolean>")
PROMPT_SCHEMA = (f"prompt_id string, prompt_text string, category string, plutchik_dist map<string,double>, "
                 f"mix_weights {MIX}, primary_expert string, secondary_experts array<string>, context_features {CONTEXT}")
PAIR_SCHEMA = ("prompt_id string, pair_id string, difficulty string, movie1_id string, movie2_id string, "
               "hardness_score double")
JUDGMENT_SCHEMA = "prompt_id string, pair_id string, m1_gt_m2 int, winner string, confidence double"


#: Files up to this size are read whole by one task; larger documents are cut by byte ranges.
WHOLE_FILE_BYTES = 64 << 20


def is_large(spark: SparkSession, path: str) -> bool:
    return (spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0) > WHOLE_FILE_BYTES


def whole_documents(spark: SparkSession, path: str, inside: list[str] | None = None) -> DataFrame:
    """JSON documents (value): one per file, or of large files one per member (see `json_split.documents`)."""
    if is_large(spark, path):
        return json_split.documents(spark, path, inside)
    return spark.read.text(path, wholetext=True)


def first_character(spark: SparkSession, path: str) -> str:
    """First character of a text file that is not blank, or an empty string."""
    first = spark.read.option("lineSep", "}").text(path).where(F.trim(F.translate("value", "\t\r\n", "   ")) != "").limit(1).first()
    return first["value"].lstrip("\ufeff \t\r\n")[:1] if first else ""


def is_json_list(spark: SparkSession, path: str) -> bool:
    return first_character(spark, path) == "["


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """parquet, JSON lines, JSON list, CSV or TSV, told apart by suffix (and by the first character for JSON).

    CSV and TSV are split between tasks; with `multiline` quoted fields may hold line breaks, and a file goes to one task.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix in ("parquet", "pq"):
        return reader.parquet(path)
    if suffix in ("jsonl", "json"):
        if suffix == "json" and is_json_list(spark, path):
            if is_large(spark, path):
                elements = json_split.members(spark, path)[0]
                shape = schema if schema is not None else spark.read.json(elements.rdd.map(lambda r: r[0])).schema
                return elements.select(F.from_json("text", shape).alias("r")).select("r.*")
            return reader.option("multiLine", True).json(path)
        return reader.json(path)
    if suffix in ("csv", "tsv"):
        options = {"header": True, "sep": "," if suffix == "csv" else "\t", "quote": '"', "escape": '"', "multiLine": multiline}
        if schema is None:
            options["inferSchema"] = True
        return reader.options(**options).csv(path)
    raise ValueError(f"unsupported file type: {path}")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a folder as parquet, or else as JSON lines."""
    return read_first(spark, [f"{folder}/chunks.parquet", f"{folder}/chunks.jsonl"])


def read_first(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """First of several candidate files that can be read."""
    from pyspark.errors import AnalysisException
    for path in paths:
        try:
            return read_table(spark, path, schema)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {paths} exists")


def ratings_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tab separated user, item, rating, epoch seconds."""
    return lines.select(F.from_csv(F.col(value), RATINGS, {"sep": "\t"}).alias("r")).select("r.*")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=RATINGS)


def _item_columns() -> list[Column]:
    flagged = F.filter(F.array(*[F.when(F.col(f"g{i}") == 1, F.lit(g)) for i, g in enumerate(GENRE_FLAGS)]),
                       lambda g: g.isNotNull())
    genres = F.when(F.size(flagged) > 0, flagged).otherwise(F.array(F.lit("unknown")))
    year = tx.year_of_title(F.col("title"), F.col("release_date"))
    return [F.col("movie_id"), F.col("title"), year.alias("year"), tx.decade(year).alias("decade"), genres.alias("genres"),
            tx.title_tokens(F.col("title")).alias("tokens")]


def _with_emotions(items: DataFrame) -> DataFrame:
    return items.withColumn("emo", co.genre_emotions(F.col("genres"), GENRE_EMOTIONS, GENRE_PRIOR))


def items_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """24 pipe separated columns: genres from the flags, year, decade, title words, genre emotions."""
    parsed = lines.select(F.from_csv(F.col(value), ITEM_LINE.simpleString()[7:-1].replace(":", " "), {"sep": "|", "quote": "\u0000"})
                          .alias("r")).select("r.*")
    return _with_emotions(parsed.select(*_item_columns()))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="|", schema=ITEM_LINE, encoding="ISO-8859-1", quote="")
    return _with_emotions(rows.select(*_item_columns()))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", schema="user_id BIGINT, age INT, sex STRING, occupation STRING, zip STRING")


def flatten_prompts(prompts: DataFrame) -> DataFrame:
    """Nested prompt records with mix_* and context columns at the top level."""
    return prompts.select(
        "prompt_id", "prompt_text", "category", "plutchik_dist", "primary_expert",
        *[F.col(f"mix_weights.{e}").alias(f"mix_{e}") for e in ("alpha", "beta", "gamma", "delta")],
        *[F.col(f"context_features.{c}").alias(c) for c in (
            "length_bucket", "persona_style", "multi_intent", "cold_user", "has_genre_terms", "has_negation", "has_year",
            "length_words", "num_genre_terms")])


def join_triplets(prompts: DataFrame, pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Pairs with integer item ids, their label, and the flattened prompt attributes."""
    from tetrarank.operators.preferences import judged_pairs
    label = F.coalesce(F.when(F.col("m1_gt_m2").isNotNull(), co.preference_label(F.col("m1_gt_m2"), None)),
                       co.preference_label(None, F.col("winner")))
    labelled = judgments.select("prompt_id", "pair_id", label.alias("y"))
    typed = pairs.withColumns({c: co.to_id(F.col(c)) for c in ("movie1_id", "movie2_id")})
    return judged_pairs(typed, labelled, flatten_prompts(prompts))


def read_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """prompts.json, pairs.json and judgments.json of a folder, joined."""
    frames = [read_table(spark, f"{folder}/{name}.json", schema) for name, schema in (
        ("prompts", PROMPT_SCHEMA), ("pairs", PAIR_SCHEMA), ("judgments", JUDGMENT_SCHEMA))]
    return join_triplets(*frames)


def rankings_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """{prompt_id: [{movieId, score, reason}]} to rows with a 0-based rank; entries without movie or score
    are dropped after ranking."""
    entry = "map<string,array<struct<movieId:string,score:double,reason:string>>>"
    lists = rows.select(F.explode(F.from_json(F.col(value), entry)).alias("prompt_id", "list"))
    ranked = lists.select("prompt_id", F.posexplode("list").alias("rank", "e"))
    return (ranked.select("prompt_id", "rank", co.to_id(F.col("e.movieId")).alias("movieId"), F.col("e.score").alias("score"),
                          F.col("e.reason").alias("reason")).where("movieId is not null and score is not null"))


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return rankings_from_json(whole_documents(spark, path))


def prompts_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """prompt_id and text from a list of records, or from an object of texts or records, under any known key."""
    record = "prompt_id:string,text:string,prompt_text:string,prompt:string,query:string"
    listed = rows.where(F.ltrim(value).startswith("[")).select(
        F.explode(F.from_json(F.col(value), f"array<struct<{record}>>")).alias("r")).select(
        F.col("r.prompt_id").alias("prompt_id"), F.col("r").alias("r"))
    keyed = rows.where(F.ltrim(value).startswith("{")).select(
        F.explode(F.from_json(F.col(value), "map<string,string>")).alias("prompt_id", "raw"))
    nested = F.from_json(F.when(F.ltrim("raw").startswith("{"), F.col("raw")), f"struct<{record}>")

    def text(r: Column) -> Column:
        return F.coalesce(*[F.when(r[k] != "", r[k]) for k in ("text", "prompt_text", "prompt", "query")], F.lit(""))

    from_list = listed.where("prompt_id is not null").select("prompt_id", text(F.col("r")).alias("text"))
    from_map = keyed.select("prompt_id", F.when(F.ltrim("raw").startswith("{"), text(nested)).otherwise(F.col("raw")).alias("text"))
    return from_list.unionByName(from_map)


def read_prompts(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    prompts = prompts_from_json(whole_documents(spark, path))
    return prompts.where(F.col("prompt_id").isin(ids)) if ids else prompts


def emotion_records_from_json(rows: DataFrame, value: str = "value") -> DataFrame:
    """Records (one JSON text each) of an emotion source: a list, {"movies": [...]} (also data, items,
    results), or an object keyed by id."""
    text = F.col(value)
    inner = F.coalesce(*[F.when(F.get_json_object(text, f"$.{k}").startswith("["), F.get_json_object(text, f"$.{k}"))
                         for k in ("movies", "data", "items", "results")])
    as_list = F.coalesce(F.when(F.ltrim(text).startswith("["), text), inner)
    listed = rows.where(as_list.isNotNull()).select(
        F.lit(None).cast("string").alias("key"), F.explode(F.from_json(as_list, "array<string>")).alias("record"))
    keyed = rows.where(as_list.isNull()).select(
        F.explode(F.from_json(text, "map<string,string>")).alias("key", "record"))
    return listed.unionByName(keyed)


def emotion_index(records: DataFrame, epsilon: float = 1e-9, how: str = "max") -> DataFrame:
    """movieId, emo, title from JSON records of any accepted shape; records without id are left out and
    repeated ids merged."""
    fields = [*EMOTIONS, "emotions", "scores", "label", "top_emotion", "emotion", "confidence", "score", "prob", "p"]
    lower = F.transform_keys(F.from_json(F.col("record"), "map<string,string>"), lambda k, _: F.lower(k))

    def first(keys: list[str]) -> Column:
        return F.coalesce(*[F.try_element_at(lower, F.lit(k.lower())) for k in keys])

    flat = records.select(
        co.to_id(F.coalesce(first(ID_KEYS), F.col("key"))).alias("movieId"), first(TITLE_KEYS).alias("title"),
        F.col("record"), *[F.try_element_at(lower, F.lit(f.lower())).alias(f) for f in fields])
    flat = flat.where("movieId is not null").withColumn("__rid", F.concat_ws("|", "movieId", F.md5("record")))
    scores = em.labelled_scores(flat, "__rid", fields)
    vectors = em.emotion_vectors(scores, "__rid", epsilon)
    from tetrarank.functions.distributions import uniform
    described = flat.select("__rid", "movieId", "title").distinct().join(vectors, "__rid", "left").withColumn(
        "emo", F.coalesce("emo", uniform()))
    return em.merge_duplicates(described, "movieId", how)


def read_emotion_source(spark: SparkSession, path: str, epsilon: float = 1e-9, how: str = "max") -> DataFrame:
    """Emotion index of a parquet, CSV, TSV or JSON lines table, or of a JSON document in any accepted shape.

    Another kind of file, a document that is neither a list nor an object, and an input without one valid row are errors.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    key = F.lit(None).cast("string").alias("key")
    if suffix in ("parquet", "pq", "csv", "tsv"):
        records = read_table(spark, path).select(key, F.to_json(F.struct("*")).alias("record"))
    elif suffix == "jsonl" or suffix == "json" and _is_json_lines(spark, path):
        records = spark.read.text(path).where(F.trim("value") != "").select(key, F.col("value").alias("record"))
    elif suffix == "json":
        if first_character(spark, path) not in ("[", "{"):
            raise ValueError(f"{path}: expected a JSON list or object")
        records = emotion_records_from_json(whole_documents(spark, path, ["movies", "data", "items", "results"]))
    else:
        raise ValueError(f"unsupported file type: {path}")
    index = emotion_index(records, epsilon, how)
    if not index.limit(1).count():
        raise ValueError(f"{path}: no valid rows")
    return index


def _is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first two lines that are not blank are objects of their own; of a large file, whether two objects follow each other."""
    if is_large(spark, path):
        return json_split.is_lines(spark, path)
    lines = [r["value"].strip() for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    return len(lines) == 2 and all(x.startswith("{") and x.endswith("}") for x in lines)


def read_emotion_index(spark: SparkSession, folder: str) -> DataFrame:
    """Emotion index of a folder: meta or emotion table, parquet before JSON."""
    rows = read_first(spark, [f"{folder}/{f}" for f in ("meta.parquet", "emotion.parquet", "meta.json", "emotion.json")])
    key = next(c for c in rows.columns if c.lower() == "movieid")
    return em.index_from_columns(rows.withColumnRenamed(key, "movieId"), "movieId")


def read_embeddings(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """Embedding table; a job that meets a vector of another size fails with both sizes."""
    rows = read_table(spark, path)
    if vector not in rows.columns:
        raise KeyError(f"{path} has no column {vector}")
    size = rows.agg(F.max(F.size(vector)).alias("d")).scalar()
    wrong = F.raise_error(F.lit("embeddings differ in size"))
    return rows.withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(
        wrong.cast(rows.schema[vector].dataType)))


def parsed_responses(responses: DataFrame, value: str = "response", key: str = "prompt_id") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) model responses.

    Code fences are removed, then the whole text and a series of ever looser cuts are tried; an object with
    `results` is preferred over any other object.
    """
    text = F.regexp_replace(F.regexp_replace(tx.strip(tx.or_empty(F.col(value))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    # Shapes of a JSON object inside other text, strictest first.
    patterns = [r'(?s)\{"results"\s*:\s*\{.*?\}\s*\}(?=\s*[,\]\}]|\s*$)', r'(?s)\{"results"\s*:\s*\{.*\}',
                r'(?s)\{.*"results".*\}', r"(?s)\{.*?\}", r"(?s)\{.*\}"]
    whole = F.when(F.col("__t").startswith("{") & F.col("__t").endswith("}"), F.array("__t")).otherwise(
        F.array().cast("array<string>"))
    cuts = [F.regexp_extract_all(F.col("__t"), F.lit(p), F.lit(0)) for p in patterns]
    valid = F.filter(F.concat(whole, *cuts), lambda c: F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{"))
    with_results = F.filter("__valid", lambda c: F.get_json_object(c, "$.results").isNotNull())
    whole_ok = F.filter(whole, lambda c: F.try_parse_json(c).isNotNull())
    best = F.coalesce(F.try_element_at(whole_ok, F.lit(1)), F.try_element_at(with_results, F.lit(1)),
                      F.try_element_at(F.col("__valid"), F.lit(1)))
    tried = responses.withColumn("__t", text).withColumn("__valid", valid).withColumn("json", best)
    keep = [c for c in responses.columns if c != value]
    return (tried.where("json is not null").select(*keep, "json"),
            tried.where("json is null").select(*keep, F.substring("__t", 1, 800).alias("preview")))


def results_by_prompt(parsed: DataFrame, json: str = "json") -> DataFrame:
    """prompt_key, result from {results: {id: ...}} or {results: [{prompt_id, ...}]}, keys without padding."""
    results = F.get_json_object(F.col(json), "$.results")
    from_map = F.transform(F.map_entries(F.from_json(F.when(results.startswith("{"), results), "map<string,string>")),
                           lambda kv: F.struct(kv["key"].alias("k"), kv["value"].alias("v")))
    from_list = F.transform(F.from_json(F.when(results.startswith("["), results), "array<string>"),
                            lambda s: F.struct(F.get_json_object(s, "$.prompt_id").alias("k"), s.alias("v")))
    entries = parsed.select(F.explode(F.coalesce(from_map, from_list)).alias("e"))
    return entries.select(co.canonical_key(F.col("e.k")).alias("prompt_key"), F.col("e.v").alias("result"))


def lookup_results(prompts: DataFrame, results: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Results joined to prompts under any padding of the id."""
    return prompts.withColumn("prompt_key", co.canonical_key(F.col(key))).join(results, "prompt_key", "left").drop("prompt_key")
