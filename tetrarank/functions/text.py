"""Text preparation as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tetrarank.constants import EMOTION_LEXICON, EMOTIONS, PROMPT_STOPWORDS
from tetrarank.functions.vectors import let

# Unicode white space, written out because regex engines disagree on what \s covers.
WHITE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NOT_WHITE = WHITE.replace("[", "[^", 1)

# Patterns of encyclopedia markup removed from item text.
CITATION_LINE = rf"(?md)^{WHITE}*\^[^\n]*$"
CITATION_ERROR = r"(?i)Cite error:[^\n]*"
REFERENCE_MARK = r"\[[0-9]+\]"
TEMPLATE = r"\{\{[^\n]*?\}\}"
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=[A-Z0-9"'])"""
SHORT_PARAGRAPH_WORDS = 60


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# The same characters, one by one.
WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def squeeze(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(or_empty(text), f"{WHITE}+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(or_empty(text), F.lit(f"{NOT_WHITE}+"))


def has_words(text: Column, least: int) -> Column:
    """Whether there are at least so many words; no character after them is looked at."""
    return or_empty(text).rlike(rf"\A{WHITE}*+(?:{NOT_WHITE}++{WHITE}*+){{{least}}}")


def clean_text(text: Column) -> Column:
    """Remove citation lines, citation errors, [n] marks and {{templates}}."""
    out = or_empty(text)
    for pattern in (CITATION_LINE, CITATION_ERROR, REFERENCE_MARK, TEMPLATE):
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def sentences(text: Column) -> Column:
    """Paragraphs; those of 60 or more words are split after sentence ends."""
    paragraphs = F.filter(F.transform(F.split(strip(or_empty(text)), r"\n{2,}"), strip), lambda p: p != "")
    split_up = F.transform(
        paragraphs,
        lambda p: F.when(~has_words(p, SHORT_PARAGRAPH_WORDS), F.array(p))
        .otherwise(F.filter(F.transform(F.split(p, SENTENCE_BREAK), strip), lambda s: s != "")))
    return F.flatten(split_up)


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, in order, with repeats."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit("[a-z0-9]+"), F.lit(0))


def boosted_tokens(title: Column, *texts: Column, boost: int = 2) -> Column:
    """Title tokens `boost` times, then the tokens of each text."""
    title_tokens = F.flatten(F.array_repeat(tokens(title), max(1, int(boost))))
    return F.concat(title_tokens, *[tokens(t) for t in texts])


def prompt_tokens(text: Column) -> Column:
    """Words of a prompt (letters and apostrophes) without stopwords."""
    words = F.regexp_extract_all(F.lower(or_empty(text)), F.lit("[a-z']+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in PROMPT_STOPWORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(or_empty(title)), F.lit("[a-z]+"), F.lit(0)))


def year_prefix(date: Column) -> Column:
    """First four characters of a date string when they are digits, else empty."""
    return F.regexp_extract(or_empty(date), r"^([0-9]{4})", 1)


def year_of_title(title: Column, date: Column, default: int = 1995) -> Column:
    """Year in the last parentheses of the title, else the last four digits of the date, else `default`."""
    in_title = F.regexp_extract(strip(or_empty(title)), r"\(\s*([0-9]+)\s*\)*$", 1)
    in_date = F.regexp_extract(strip(or_empty(date)), "([0-9]{4})$", 1)
    return F.coalesce(in_title.try_cast("int"), in_date.try_cast("int"), F.lit(default))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def first_text(*texts: Column) -> Column:
    """First text that is not blank, else empty."""
    return F.coalesce(*[F.when(strip(t) != "", t) for t in texts], F.lit(""))


def shorten(text: Column, limit: int) -> Column:
    """Squeeze and cut to `limit` characters, the last three of them dots."""
    return let(squeeze(text), lambda t: F.when(
        F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t))


def candidate_line(item_id: Column, title: Column, year: Column, rating: Column, plot: Column) -> Column:
    """`[id] title (year) [User Rating: stars]: plot`, absent parts left out."""
    return F.concat(
        F.lit("["), item_id.cast("string"), F.lit("] "), or_empty(title),
        F.when(or_empty(year) != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(F.lit("")),
        F.when(rating.isNotNull(),
               F.concat(F.lit(" [User Rating: "), F.repeat(F.lit("★"), rating.cast("int")), F.lit("]")))
        .otherwise(F.lit("")),
        F.when(or_empty(plot) != "", F.concat(F.lit(": "), plot)).otherwise(F.lit("")))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.lower(strip(or_empty(text))), "[^a-z0-9]+", "_")
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


def normalized_category(text: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(or_empty(text))), F.lit("")), F.lit("unknown"))


def sanitized_reason(text: Column, limit: int = 140) -> Column:
    return F.substring(squeeze(text), 1, limit)


def token_estimate(text: Column) -> Column:
    """Four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(or_empty(text)) / 4)).cast("long")


def rounded_token_estimate(text: Column) -> Column:
    """Length / 4 rounded half to even."""
    return F.bround(F.length(text) / F.lit(4.0), 0).cast("long")


def combined_chunk_text(overview: Column, plot: Column) -> Column:
    """`Overview:` and `Plot:` sections of the cleaned texts; empty sections left out."""
    def section(name: str, body: Column) -> Column:
        return let(clean_text(body), lambda t: F.when(t != "", F.concat(F.lit(f"{name}:\n"), t)))

    return F.concat_ws("\n\n", section("Overview", overview), section("Plot", plot))


def length_bucket(n_words: Column) -> Column:
    return F.when(n_words < 10, F.lit("short")).when(n_words < 20, F.lit("medium")).otherwise(F.lit("long"))


def has_negation(text: Column) -> Column:
    low = F.lower(or_empty(text))
    return low.contains("no ") | low.contains("not ") | low.contains("without")


def mentions_year(text: Column) -> Column:
    """Any of the digit runs 1950 to 2029."""
    return or_empty(text).rlike("19[5-9][0-9]|20[0-2][0-9]")


def genre_mentions(text: Column, genres: list[str]) -> Column:
    """How often any genre name occurs, counted without overlaps per genre."""
    low = F.lower(or_empty(text))
    total = F.lit(0)
    for genre in genres:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(genre.lower()), F.lit(""))))
                         / len(genre)).cast("int")
    return total


def lexicon_vector(text: Column) -> Column:
    """Per emotion, how many of its keywords occur in the text; array of eight doubles."""
    def hits(low: Column, runs: Column, words: list[str]) -> Column:
        # A plain word stands alone exactly when it is a whole run of letters; hyphenated ones need a search.
        plain = F.array(*[F.lit(w) for w in words if "-" not in w])
        found = F.size(F.array_intersect(plain, runs))
        for w in words:
            if "-" in w:
                found = found + (low.contains(w) & low.rlike(f"(^|[^a-z]){w}([^a-z]|$)")).cast("int")
        return found.cast("double")

    return let(F.lower(or_empty(text)), lambda low: let(
        F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))),
        lambda runs: F.array(*[hits(low, runs, EMOTION_LEXICON[e]) for e in EMOTIONS])))


def rationale(genres: Column, year: Column, emotion: Column, target_genres: Column, max_words: int = 25) -> Column:
    """Short reason: first genre and year, emotion, and whether requested genres match."""
    has_target = F.size(F.coalesce(target_genres, F.array().cast("array<string>"))) > 0
    phrase = F.concat_ws(
        ", ",
        F.when(F.size(genres) > 0, F.concat(F.element_at(genres, 1), F.lit(" film from "), year.cast("string")))
        .otherwise(F.concat(F.lit("Film from "), year.cast("string"))),
        F.when(or_empty(emotion) != "", F.concat(F.lit("evokes "), F.lower(emotion))),
        F.when(has_target & F.arrays_overlap(genres, target_genres), F.lit("matches requested genres"))
        .when(has_target, F.lit("diverges from requested genres")))
    return F.array_join(F.slice(F.split(phrase, " "), 1, max_words), " ")
