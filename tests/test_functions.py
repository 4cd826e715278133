import math

import pytest
from conftest import one
from pyspark.sql import functions as F

from tetrarank.constants import EMOTIONS, GENRE_EMOTIONS, GENRE_PRIOR
from tetrarank.functions import coerce as co
from tetrarank.functions import distributions as dx
from tetrarank.functions import numeric as nx
from tetrarank.functions import text as tx
from tetrarank.functions import vectors as vx


def value(spark, column):
    return one(spark.range(1).select(column.alias("x")))["x"]


def test_clean_text(spark):
    raw = "Hello [1] world\n ^ a citation\n{{tmpl|x}} and more  Cite error: whatever\nlast"
    assert value(spark, tx.clean_text(F.lit(raw))) == "Hello world and more last"
    assert value(spark, tx.clean_text(F.lit(None).cast("string"))) == ""


def test_sentences(spark):
    long = "Alpha beta. Word " + "word " * 60 + "end! Next one? no split here. \"Quoted\" tail."
    got = value(spark, tx.sentences(F.lit("Short. Para stays.\n\n\n" + long)))
    assert got[0] == "Short. Para stays."
    assert got[1] == "Alpha beta."
    assert got[-1] == '"Quoted" tail.'
    assert got[-2].startswith("Next one? no split")
    assert value(spark, tx.sentences(F.lit("  "))) == []


def test_tokens_and_boost(spark):
    assert value(spark, tx.tokens(F.lit("It's 2 GOOD-é x"))) == ["it", "s", "2", "good", "x"]
    assert value(spark, tx.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, tx.boosted_tokens(F.lit("A b"), F.lit("c"), boost=2)) == ["a", "b", "a", "b", "c"]
    assert value(spark, tx.prompt_tokens(F.lit("I want a film that's good"))) == ["film", "that's", "good"]


@pytest.mark.parametrize("title,date,year", [
    ("Toy Story (1995)", None, 1995), ("A (b) (1987)", "01-Jan-1990", 1987), ("Plain", "01-Jan-1990", 1990),
    ("Plain", None, 1995), ("Odd (x)", "", 1995)])
def test_year_of_title(spark, title, date, year):
    assert value(spark, tx.year_of_title(F.lit(title), F.lit(date).cast("string"))) == year


def test_shorten_and_lines(spark):
    assert value(spark, tx.shorten(F.lit("a  b\n" + "c" * 10), 10)) == "a b ccc..."
    assert value(spark, tx.shorten(F.lit("short"), 10)) == "short"
    line = tx.candidate_line(F.lit(3), F.lit("T"), F.lit("1999"), F.lit(2), F.lit("p"))
    assert value(spark, line) == "[3] T (1999) [User Rating: ★★]: p"
    bare = tx.candidate_line(F.lit(3), F.lit("T"), F.lit(""), F.lit(None).cast("int"), F.lit(None).cast("string"))
    assert value(spark, bare) == "[3] T"
    assert value(spark, tx.slug(F.lit("  Sci-Fi & More "))) == "sci_fi_more"
    assert value(spark, tx.slug(F.lit("!!"))) == "unknown"
    assert value(spark, tx.normalized_category(F.lit(None).cast("string"))) == "unknown"
    assert value(spark, tx.rounded_token_estimate(F.lit("x" * 10))) == 2  # 2.5 rounds to even
    assert value(spark, tx.token_estimate(F.lit("x"))) == 1


def test_prompt_flags(spark):
    t = F.lit("Not a horror film from 1999, no Horror")
    assert value(spark, tx.has_negation(t)) is True
    assert value(spark, tx.mentions_year(t)) is True
    assert value(spark, tx.genre_mentions(t, ["Horror", "War"])) == 2
    r = tx.rationale(F.array(F.lit("Drama")), F.lit(1990), F.lit("Joy"), F.array(F.lit("War")))
    assert value(spark, r) == "Drama film from 1990, evokes joy, diverges from requested genres"


def test_lexicon_boundaries(spark):
    v = value(spark, tx.lexicon_vector(F.lit("A feel-good, HAPPY movie; unhappy, hopeful7 build-ups")))
    got = dict(zip(EMOTIONS, v))
    # "feel-good" and "happy" stand alone; "build-ups" does not match "build-up", "hopeful7" does match "hopeful".
    assert got["Joy"] == 2 and got["Anticipation"] == 1 and sum(v) == 3


def test_vectors(spark):
    a, b = F.array(*[F.lit(x) for x in (3.0, 4.0)]), F.array(*[F.lit(x) for x in (4.0, 3.0)])
    assert value(spark, vx.dot(a, b)) == 24
    assert value(spark, vx.norm(a)) == 5
    assert value(spark, vx.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vx.squared_l2(a, b)) == 2
    assert value(spark, vx.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_simplex_edges(spark):
    def arr(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    assert value(spark, dx.simplex(arr(1, -1, 3, 0, 0, 0, 0, 0))) == [0.25, 0, 0.75, 0, 0, 0, 0, 0]
    assert value(spark, dx.simplex(arr(*[0] * 8))) == [0.125] * 8
    assert value(spark, dx.simplex(arr(1, 2))) == [0.125] * 8
    assert value(spark, dx.simplex(F.lit(None).cast("array<double>"))) == [0.125] * 8
    assert value(spark, dx.smoothed_simplex(arr(*[0] * 8))) == [0.125] * 8


def test_js_similarity(spark):
    def arr(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    p, q = arr(1, 0, 0, 0, 0, 0, 0, 0), arr(0, 1, 0, 0, 0, 0, 0, 0)
    assert value(spark, dx.js_similarity(p, p)) == pytest.approx(1.0, abs=1e-6)
    assert value(spark, dx.js_similarity(p, q)) == pytest.approx(1 - math.sqrt(math.log(2)), abs=1e-6)
    assert value(spark, dx.js_similarity(p, q, "norm")) == pytest.approx(0.0, abs=1e-6)
    assert value(spark, dx.entropy_bits(arr(1, 1, 1, 1))) == pytest.approx(2.0)
    assert value(spark, dx.kl_divergence(p, p)) == pytest.approx(0.0)
    assert value(spark, dx.l1_distance(p, q)) == 2.0
    assert sum(value(spark, dx.softmax(arr(1, 2, 1000)))) == pytest.approx(1.0)
    assert value(spark, dx.argmax(arr(1, 5, 5))) == 1


def test_ties_and_losses(spark):
    def agree(margin, y):
        return value(spark, nx.agreement(F.lit(margin), F.lit(y)))

    assert agree(0.05, 1) == 0 and agree(-0.05, 0) == 0 and agree(0.051, 1) == 1 and agree(0.051, 0) == -1
    assert value(spark, nx.softplus(F.lit(0.0))) == pytest.approx(math.log(2))
    assert value(spark, nx.pair_loss(F.lit(2.0), F.lit(1))) == pytest.approx(math.log1p(math.exp(-2)))
    focal = value(spark, nx.pair_loss(F.lit(0.0), F.lit(1), 2.0))
    assert focal == pytest.approx(math.log(2) * 0.25)
    assert value(spark, nx.pair_confidence(F.lit(-0.25), F.lit("easy"))) == 0.9
    u = value(spark, nx.hash_uniform(F.lit("k")))
    assert 0 <= u < 1 and u == value(spark, nx.hash_uniform(F.lit("k")))
    assert value(spark, nx.calibrated_margin(F.lit(2.0), F.lit("Easy"), "easy:0.5", "hard:1")) == 1.0
    assert value(spark, nx.calibrated_margin(F.lit(2.0), F.lit(None).cast("string"), "easy:0.5")) == 2.0
    d, w = [F.lit(0.1), F.lit(-0.5), F.lit(0.0), F.lit(0.2)], [F.lit(0.25)] * 4
    assert value(spark, nx.top_signals(d, w, ["a", "b", "c", "d"])) == "b and d"
    assert value(spark, nx.top_signals([F.lit(0.0)] * 4, w, ["a", "b", "c", "d"])) == "a"
    assert value(spark, nx.hardness(d, w)) == pytest.approx(0.8)


@pytest.mark.parametrize("raw,want", [("12", 12), ("12.0", 12), ('{"id": 12}', 12), ("12:plot:1", 12), ("x", None), (None, None)])
def test_to_id(spark, raw, want):
    assert value(spark, co.to_id(F.lit(raw).cast("string"))) == want


def test_flags_keys_specs(spark):
    assert value(spark, co.to_flag(F.lit(" Yes "))) is True
    assert value(spark, co.to_flag(F.lit("0"))) is False
    assert value(spark, co.to_flag(F.lit("na"))) is None
    assert value(spark, co.canonical_key(F.lit("0001"))) == "1"
    assert value(spark, co.canonical_key(F.lit("000"))) == "0"
    assert value(spark, co.canonical_key(F.lit("a01"))) == "a01"
    spec = value(spark, co.emotion_from_spec(F.lit("joy=0.4,Trust=0.2,bad=1,Fear=x")))
    assert spec == [0.4, 0.2, 0, 0, 0, 0, 0, 0]
    assert value(spark, co.emotion_from_spec(F.lit("Anger")))[5] == 1.0
    assert value(spark, co.emotion_from_spec(F.lit('{"surprise": 3}')))[6] == 3.0
    assert value(spark, co.emotion_from_spec(F.lit("nothing known"))) is None
    assert value(spark, co.emotion_from_json(F.lit('{"emotions": {"Joy": 1, "Fear": 3}}')))[2] == 0.75
    assert value(spark, co.emotion_from_json(F.lit("[1,1,1,1,1,1,1,1]"))) == [0.125] * 8
    assert value(spark, co.emotion_from_json(F.lit("broken"))) == [0.125] * 8
    assert value(spark, co.dominant_emotion(F.lit(None).cast("array<double>"))) == "joy"
    genres = value(spark, co.genre_emotions(F.array(F.lit("War"), F.lit("Horror")), GENRE_EMOTIONS, GENRE_PRIOR))
    assert dict(zip(EMOTIONS, genres))["Anger"] == pytest.approx(1.1 / 4.8)
    assert value(spark, co.poster_url(F.lit(" "), "http://x")) is None
