"""Lenient conversion of ids, flags, labels and JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tetrarank.constants import EMOTION_SYNONYMS, EMOTIONS, HIT_ID_KEYS, HIT_SCORE_KEYS
from tetrarank.functions.distributions import simplex

TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]


def to_flag(value: Column) -> Column:
    """true / 1 / yes become true, false / 0 / no become false, anything else null."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def to_id(value: Column) -> Column:
    """Integer id from `12`, `12.0`, `{"id": 12}` or `12:plot:1`; null when there is none."""
    text = F.trim(value.cast("string"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), text.try_cast("double").try_cast("long"))
    nested = F.when(text.startswith("{"), F.get_json_object(text, "$.id").try_cast("long"))
    head = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("long")
    return F.coalesce(whole, nested, head)


def canonical_key(value: Column) -> Column:
    """Prompt key without padding: `0001`, ` 1 ` and `1` are the same."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(text, "^0+(?=[0-9]+$)", ""))


def preference_label(m1_gt_m2: Column | None, winner: Column | None) -> Column:
    """1 when the first item wins, by sign column or by winner name."""
    if m1_gt_m2 is not None:
        return F.when(m1_gt_m2 == 1, 1).otherwise(0)
    return F.when(F.lower(winner).isin("m1", "movie1", "a"), 1).otherwise(0)


def canonical_emotion(label: Column) -> Column:
    """Canonical emotion of a loose label, null for unknown labels."""
    pairs = [F.lit(x) for item in EMOTION_SYNONYMS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(label)))


def emotion_array(scores: Column) -> Column:
    """Map of emotion name to value, as an array in canonical order."""
    return F.array(*[F.coalesce(F.try_element_at(scores, F.lit(e)).cast("double"), F.lit(0.0)) for e in EMOTIONS])


def emotion_from_json(text: Column) -> Column:
    """Simplex from a JSON map, a map under `emotions`, or an array of eight; else uniform."""
    nested = F.get_json_object(text, "$.emotions")
    as_map = F.from_json(F.coalesce(F.when(nested.startswith("{"), nested), text), "map<string,double>")
    as_array = F.from_json(text, "array<double>")
    vector = (F.when(F.ltrim(text).startswith("{"), emotion_array(as_map))
              .when(F.ltrim(text).startswith("["), as_array))
    return simplex(F.coalesce(vector, F.array().cast("array<double>")))


def emotion_from_spec(spec: Column) -> Column:
    """Raw vector from `Joy`, `Joy=0.4,Trust=0.2` or a JSON map; null when the text is none of them."""
    text = F.trim(spec)
    listed = F.transform(F.split(text, ","), lambda t: F.struct(
        F.initcap(F.trim(F.split_part(t, F.lit("="), F.lit(1)))).alias("k"),
        F.trim(F.split_part(t, F.lit("="), F.lit(2))).try_cast("double").alias("v")))

    def last_value(emotion: str) -> Column:
        return F.aggregate(listed, F.lit(0.0), lambda acc, kv: F.when(
            (kv["k"] == emotion) & kv["v"].isNotNull(), kv["v"]).otherwise(acc))

    explicit = F.array(*[last_value(e) for e in EMOTIONS])
    from_map = F.transform_keys(F.from_json(text, "map<string,string>"), lambda k, _: F.initcap(F.trim(k)))
    mapped = F.array(*[F.coalesce(F.try_element_at(from_map, F.lit(e)).try_cast("double"), F.lit(0.0))
                       for e in EMOTIONS])
    single = F.array(*[(F.initcap(text) == e).cast("double") for e in EMOTIONS])
    return (F.when(text.startswith("{"), mapped)
            .when(text.contains("="), explicit)
            .when(F.initcap(text).isin(EMOTIONS), single))


def hit_item_id(hit: Column, fields: list[str]) -> Column:
    """Item id of a hit struct: first id key present, else the head of its chunk id."""
    found = [hit[k].cast("string") for k in HIT_ID_KEYS if k in fields]
    if "chunkId" in fields:
        found.append(hit["chunkId"].cast("string"))
    return to_id(F.coalesce(*found)) if found else F.lit(None).cast("long")


def hit_score(hit: Column, fields: list[str]) -> Column:
    """First non-null score key of a hit struct, as double."""
    found = [hit[k].cast("string").try_cast("double") for k in HIT_SCORE_KEYS if k in fields]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def poster_url(path: Column, base: str) -> Column:
    clean = F.trim(F.coalesce(path, F.lit("")))
    return F.when(clean != "", F.concat(F.lit(base), clean))


def dominant_emotion(scores: Column) -> Column:
    """Lower-case name of the largest entry of an emotion array; joy when the array is null."""
    names = F.array(*[F.lit(e.lower()) for e in EMOTIONS])
    position = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.coalesce(F.try_element_at(names, position), F.lit("joy"))


def genre_emotions(genres: Column, mapping: dict[str, list[str]], prior: float) -> Column:
    """Emotion distribution of a genre list: prior plus one per emotion a genre stands for."""
    def weight(emotion: str) -> Column:
        names = [g for g, emotions in mapping.items() if emotion in emotions]
        return F.size(F.filter(genres, lambda g: g.isin(names))) + F.lit(prior)

    return simplex(F.array(*[weight(e) for e in EMOTIONS]))
