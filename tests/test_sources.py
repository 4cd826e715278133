import json

from pyspark.sql import functions as F

from tetrarank.constants import EMOTIONS
from tetrarank.operators import items
from tetrarank.sources import readers, writers
from tetrarank.streaming.prompts import score_stream


def test_read_table_by_suffix(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "l.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c.csv").write_text('a,b\n1,"x"\n2,y\n')
    (tmp_path / "c.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    spark.createDataFrame(rows, "a long, b string").write.parquet(str(tmp_path / "p.parquet"))
    for name in ("l.json", "l.jsonl", "c.csv", "c.tsv", "p.parquet"):
        assert {(r["a"], r["b"]) for r in readers.read_table(spark, str(tmp_path / name)).collect()} == {(1, "x"), (2, "y")}
    assert readers.read_first(spark, [str(tmp_path / "none.json"), str(tmp_path / "c.csv")]).count() == 2


def test_ratings_items_users(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t5\t4\t880000000\n2\t5\t3\t880000001\n")
    assert readers.read_ratings(spark, str(tmp_path / "u.data")).where("user_id = 2").first()["rating"] == 3
    flags = ["0"] * 19
    flags[8] = flags[17] = "1"
    line = "|".join(["1", "Amélie \"x\" (2001)", "01-Jan-2000", "", "http://x", *flags])
    (tmp_path / "u.item").write_bytes((line + "\n" + "|".join(["2", "Bare", "", "", "", *["0"] * 19])).encode("latin-1"))
    got = {r["movie_id"]: r for r in readers.read_items(spark, str(tmp_path / "u.item")).collect()}
    assert got[1]["genres"] == ["Drama", "War"] and got[1]["year"] == 2001 and got[1]["decade"] == 2000
    assert got[1]["title"].startswith("Amélie") and set(got[1]["tokens"]) == {"am", "lie", "x"}
    assert got[2]["genres"] == ["unknown"] and got[2]["year"] == 1995
    lines = spark.createDataFrame([(line,)], "value string")
    assert readers.items_from_lines(lines).first()["genres"] == ["Drama", "War"]


def test_triplets(spark, tmp_path):
    (tmp_path / "prompts.json").write_text(json.dumps([{"prompt_id": "p", "prompt_text": "t", "category": "c", "mix_weights": {"alpha": 1, "beta": 0, "gamma": 0, "delta": 0},
                                                        "context_features": {"length_words": 3, "cold_user": True}}]))
    (tmp_path / "pairs.json").write_text(json.dumps([{"prompt_id": "p", "pair_id": "1", "movie1_id": "7:plot:1", "movie2_id": 8}, {"prompt_id": "q", "pair_id": "2", "movie1_id": 1, "movie2_id": 2}]))
    (tmp_path / "judgments.json").write_text(json.dumps([{"prompt_id": "p", "pair_id": "1", "m1_gt_m2": 1}, {"prompt_id": "q", "pair_id": "2", "winner": "B"}]))
    got = {r["pair_id"]: r for r in readers.read_triplets(spark, str(tmp_path)).collect()}
    assert got["1"]["movie1_id"] == 7 and got["1"]["y"] == 1 and got["1"]["cold_user"] is True and got["1"]["mix_alpha"] == 1.0
    assert got["2"]["y"] == 0 and got["2"]["prompt_text"] is None


def test_rankings_and_prompts(spark, tmp_path):
    ranking = {"0001": [{"movieId": 5, "score": 0.9, "reason": "r"}, {"score": 0.8}, {"movieId": "6", "score": 0.7}]}
    (tmp_path / "r.json").write_text(json.dumps(ranking, indent=1))
    got = readers.read_rankings(spark, str(tmp_path / "r.json")).orderBy("rank").collect()
    assert [(r["rank"], r["movieId"]) for r in got] == [(0, 5), (2, 6)]
    (tmp_path / "p.json").write_text(json.dumps({"a": "plain", "b": {"query": "nested"}, "c": {}}))
    assert {r["prompt_id"]: r["text"] for r in readers.read_prompts(spark, str(tmp_path / "p.json")).collect()} == {"a": "plain", "b": "nested", "c": ""}
    (tmp_path / "l.json").write_text(json.dumps([{"prompt_id": "a", "text": "", "prompt": "x"}, {"text": "no id"}]))
    assert [tuple(r) for r in readers.read_prompts(spark, str(tmp_path / "l.json"), ["a"]).collect()] == [("a", "x")]


def test_responses(spark):
    rows = [("1", '```json\n{"results": {"0001": {"k": 1}}}\n```'), ("2", 'thinking {"note": 1} then {"results": {"2": {"k": 2}}} done'),
            ("3", "nothing here"), ("4", '{"other": 4}'), ("5", None), ("6", '{"results": [{"prompt_id": "0006", "k": 6}]}')]
    parsed, rejected = readers.parsed_responses(spark.createDataFrame(rows, "prompt_id string, response string"))
    assert {r["prompt_id"] for r in rejected.collect()} == {"3", "5"}
    texts = {r["prompt_id"]: r["json"] for r in parsed.collect()}
    assert texts["4"] == '{"other": 4}' and texts["2"].startswith('{"results"')
    prompts = spark.createDataFrame([("1",), ("0002",), ("6",), ("9",)], "prompt_id string")
    found = {r["prompt_id"]: r["result"] for r in readers.lookup_results(prompts, readers.results_by_prompt(parsed)).collect()}
    assert json.loads(found["1"])["k"] == 1 and json.loads(found["0002"])["k"] == 2 and json.loads(found["6"])["k"] == 6 and found["9"] is None


def test_emotion_index_and_embeddings(spark, tmp_path):
    folder = tmp_path / "emo"
    folder.mkdir()
    (folder / "emotion.json").write_text(json.dumps([{"movieid": 1, **{e: i for i, e in enumerate(EMOTIONS)}}]))
    row = readers.read_emotion_index(spark, str(folder)).first()
    assert abs(sum(row["emo"]) - 1) < 1e-9 and row["emo"][7] == 0.25
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>").write.parquet(path)
    try:
        readers.read_embeddings(spark, path).collect()
        raise AssertionError("uneven vectors must fail")
    except Exception as e:
        assert "differ in size" in str(e)


def test_writers(spark, tmp_path):
    chunks = items.build_chunks(spark.createDataFrame([(1, "One two.", "three"), (2, "", " ")], "movieId long, overview string, plot string"))
    assert chunks.first()["text"] == "Overview:\nOne two.\n\nPlot:\nthree"
    writers.write_chunks(chunks, str(tmp_path / "out"))
    assert readers.read_table(spark, str(tmp_path / "out/chunks.jsonl")).count() == 1
    assert spark.read.json(str(tmp_path / "out/summary.json")).first()["total_chunks"] == 1
    hits = spark.createDataFrame([("p", i, float(i), " a\n b ") for i in range(5)], "prompt_id string, movieId long, score double, reason string")
    writers.write_results(hits, str(tmp_path / "res"), k=2)
    back = spark.read.json(str(tmp_path / "res")).collect()
    assert [(r["prompt_id"], [(x["movieId"], x["reason"]) for x in r["results"]]) for r in back] == [("p", [(4, "a b"), (3, "a b")])]
    writers.write_results(hits, str(tmp_path / "rows"), k=2, fmt="csv")
    assert [r["movieId"] for r in spark.read.csv(str(tmp_path / "rows"), header=True).orderBy("rank").collect()] == ["4", "3"]
    writers.write_report(hits.drop("reason"), str(tmp_path), "report")
    assert spark.read.option("header", True).csv(str(tmp_path / "report.csv")).count() == 5


def test_emotion_source_formats(spark, tmp_path):
    rows = [{"movieId": 1, "joy": 3.0, "fear": 1.0}, {"movieId": 2, "sadness": 2.0}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "b.json").write_text("\n\n".join(json.dumps(r) for r in rows))
    (tmp_path / "c.json").write_text(json.dumps(rows))
    (tmp_path / "d.csv").write_text("movieId,joy,fear,sadness\n1,3,1,\n2,,,2\n")
    found = [{r["movieId"]: [round(x, 6) for x in r["emo"]] for r in readers.read_emotion_source(spark, str(tmp_path / n)).collect()}
             for n in ("a.jsonl", "b.json", "c.json", "d.csv")]
    assert all(f == found[0] for f in found) and set(found[0]) == {1, 2}
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text('"text"')
    (tmp_path / "g.txt").write_text("{}")
    for name in ("e.json", "f.json", "g.txt"):
        try:
            readers.read_emotion_source(spark, str(tmp_path / name)).collect()
            raise AssertionError(f"{name} must fail")
        except ValueError as e:
            assert name in str(e)


def test_large_documents_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE_FILE_BYTES", 10)
    (tmp_path / "a.json").write_text(json.dumps([{"a": i} for i in range(9)]))
    assert sorted(r["a"] for r in readers.read_table(spark, str(tmp_path / "a.json")).collect()) == list(range(9))


def test_item_filters(spark):
    rows = spark.createDataFrame([(1, "en", "1999-05-01", False), (2, "fr", "bad", False), (3, "en", "2005-01-01", True), (4, None, None, None)],
                                 "movieId long, original_language string, release_date string, adult boolean")
    ids = lambda **c: {r["movieId"] for r in items.filter_items(rows, **c).collect()}
    assert ids() == {1, 2, 3, 4} and ids(language="en") == {1, 3} and ids(year_gte=1990) == {1, 3}
    assert ids(year_lte=2000, adult=False) == {1} and ids(kind="x") == {1, 2, 3, 4}
    ratings = spark.createDataFrame([(7, 1, 5), (8, 2, 1)], "user_id long, item_id long, rating int")
    asked = rows.select("movieId", F.explode(F.array(F.lit(7), F.lit(8))).alias("user_id"))
    rated = {(r["user_id"], r["movieId"]): r["user_rating"] for r in items.with_history(asked, ratings, "movieId").collect()}
    assert len(rated) == 8 and {k: n for k, n in rated.items() if n is not None} == {(7, 1): 5, (8, 2): 1}
    done = spark.createDataFrame([("1",)] * 3 + [("2",)], "prompt_id string")
    want = spark.createDataFrame([("1",), ("2",), ("3",)], "prompt_id string")
    assert {(r["prompt_id"], r["n_results"]) for r in items.incomplete_prompts(want, done, 2).collect()} == {("2", 1), ("3", 0)}


def test_stream_scores_each_batch(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, text string").write.parquet(str(source))
    stream = spark.readStream.schema("query_id long, text string").parquet(str(source))
    query = score_stream(stream, lambda b: b.select("query_id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert {(r["query_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 3), (2, 1)}
