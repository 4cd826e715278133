import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tetrarank.functions import text as tx
from tetrarank.operators import bm25, cascade, collaborative, dense, embed, emotion, scoring

DOCS = [(1, "the cat sat on the mat"), (2, "the dog"), (3, ""), (4, None), (5, "the cat the cat"), (6, "a dog and a cat by the door")]
ASKED = [(10, "cat cat dog"), (11, "the"), (12, "unknown words"), (13, "")]


def brute_bm25(floor=False):
    toks = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in DOCS}
    n, avgdl = len(DOCS), np.mean([max(len(t), 1) for t in toks.values()])
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    if floor:
        mean = np.mean(list(idf.values()))
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    out = {}
    for q, text in ASKED:
        for d, t in toks.items():
            words = [w for w in text.split() if w in t]
            if words:
                out[q, d] = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in words)
    return out


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build_index(spark.createDataFrame(DOCS, "id long, text string"), "id", tx.tokens(F.col("text")))


@pytest.mark.parametrize("rule", ["keep", "floor_avg"])
@pytest.mark.parametrize("limit", [5000, 1])
def test_bm25_matches_brute_force(spark, index, rule, limit):
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"]
           for r in bm25.search(index, asked, 10, negative=rule, broadcast_rows=limit).collect()}
    want = brute_bm25(rule == "floor_avg")
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert min(want.values()) < 0 or rule == "floor_avg"  # "the" and "cat" have a negative idf


def test_bm25_index_round_trip(spark, index, tmp_path):
    index.write(str(tmp_path / "ix"))
    again = bm25.BM25Index.read(spark, str(tmp_path / "ix"))
    assert again.postings.count() == index.postings.count()
    assert bm25.index_report(again).first()["n_docs"] == 6


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_dense_metrics(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    items = spark.createDataFrame(pd.DataFrame({"item_id": np.arange(60), "vector": x.astype(float).tolist()}))
    q = items.where("item_id < 5").withColumnRenamed("item_id", "query_id")
    got = dense.search(q, items, 4, metric=metric).toPandas()
    d = x.astype(float)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    scores = {"ip": unit[:5] @ d.T, "cosine": unit[:5] @ unit.T, "l2": -((d[:5, None] - d[None]) ** 2).sum(2)}[metric]
    for i in range(5):
        assert set(got[got.query_id == i].item_id) == set(np.argsort(-scores[i])[:4])
    if metric == "l2":
        assert got.score.min() == 0 and (got.score >= 0).all()


def test_dense_filters(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "item_id long, vector array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vector array<double>")
    allowed = items.where("item_id < 3")
    assert {r["item_id"] for r in dense.search(q, items, 2, metric="ip", allowed=allowed).collect()} == {1, 2}
    assert dense.search(q, items, 2, metric="ip", allowed=allowed, filter_mode="post").count() == 0


def test_provenance_and_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0], "base"), (2, [1.0, 2.0], "other")], "id long, vector array<double>, embedding_model string")
    assert dense.check_dimensions(rows).first()["consistent"] is False
    got = {r["index_model"]: r["matches"] for r in dense.provenance_mismatch(rows, "org/base-v2").collect()}
    assert got == {"base": True, "other": False}


def test_collaborative_missing_vectors(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, vector array<double>")
    items = spark.createDataFrame([(5, [2.0, 0.0]), (6, [0.0, 1.0])], "item_id long, vector array<double>")
    asked = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in collaborative.candidate_scores(asked, users, items).collect()}
    assert got[1, 5] == pytest.approx(1.0) and got[1, 6] == 0 and got[1, 7] == 0 and got[2, 5] == 0
    ids = collaborative.unique_id_map(spark.createDataFrame([(5, 9), (5, 8), (6, None)], "i long, m long"), "i", "m")
    assert [tuple(r) for r in ids.collect()] == [(5, 8)]


def test_unknown_items_in_emotion_scores(spark):
    q = spark.createDataFrame([(1, [0.125] * 8)], "query_id long, emo array<double>")
    items = spark.createDataFrame([(1, [1.0] + [0.0] * 7)], "item_id long, emo array<double>")
    asked = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, item_id long")
    sqrt = {r["item_id"]: r["score"] for r in emotion.similarity_scores(asked, q, items).collect()}
    norm = {r["item_id"]: r["score"] for r in emotion.similarity_scores(asked, q, items, mode="norm").collect()}
    assert sqrt[2] == pytest.approx(1.0, abs=1e-6) and norm[2] == 0.0 and 0 < sqrt[1] < 1


def test_pooling_and_zscores(spark):
    hits = spark.createDataFrame([(1, 1, 1.0), (1, 1, 3.0), (1, 2, 2.0), (2, 1, 5.0)], "query_id long, item_id long, score double")
    attn = {(r["query_id"], r["item_id"]): r["score"] for r in scoring.pool(hits, ["query_id", "item_id"], how="attn").collect()}
    w = math.exp(-2)
    assert attn[1, 1] == pytest.approx((3 + w) / (1 + w)) and attn[2, 1] == 5.0
    tiny = scoring.pool(hits, ["query_id", "item_id"], how="attn", temperature=0.0).where("query_id = 1 and item_id = 1").first()
    assert tiny["score"] == pytest.approx(3.0)
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 9.0), (2, 4.0), (3, 5.0), (3, 5.0)], "g long, s double")
    for mode, ddof in (("pop", 0), ("pop_strict", 0), ("clip_sample", 1)):
        z = scoring.zscores(rows, ["g"], {"s": "z"}, mode).toPandas()
        assert (z[z.g.isin([2, 3])].z == 0).all()  # single rows and constant groups
        want = (np.array([1, 2, 9]) - 4) / np.std([1, 2, 9], ddof=ddof)
        assert np.allclose(np.sort(z[z.g == 1].z), want, atol=1e-6)


def test_outer_union_and_weights(spark):
    a = spark.createDataFrame([(1, 1, 2.0)], "q long, i long, score double")
    b = spark.createDataFrame([(1, 2, 3.0)], "q long, i long, score double")
    got = {r["i"]: (r["a"], r["b"]) for r in scoring.outer_union({"a": a, "b": b}, ["q", "i"]).collect()}
    assert got == {1: (2.0, 0.0), 2: (0.0, 3.0)}
    assert scoring.normalize_weights({"x": -1.0, "y": 3.0, "z": 1.0}) == {"x": 0.0, "y": 0.75, "z": 0.25}
    assert scoring.normalize_weights({"x": 0.0}, {"x": 1.0}) == {"x": 1.0}


def test_lower_and_averaged_median(spark):
    rows = spark.createDataFrame([(1, float(x), float(x), float(x), float(x)) for x in (1, 2, 3, 4)],
                                 "query_id long, z_alpha double, z_beta double, z_gamma double, z_delta double")
    assert scoring.dz_summary(rows).first()["dz_alpha"] == 2.0
    assert scoring.dz_summary(rows, median="mean").first()["dz_alpha"] == 1.5


@pytest.mark.parametrize("w,gated,dominant", [
    ([0.9, 0.05, 0.03, 0.02], True, "alpha"), ([0.0, 0.0, 8.0, 1.0], True, "gamma"), ([0.25] * 4, False, "alpha"),
    ([0.7, 0.1, 0.1, 0.1], False, "alpha"), ([float("nan"), 1.0, 0.0, 0.0], False, "alpha"), ([None, 1.0, 0.0, 0.0], False, "alpha")])
def test_gate(spark, w, gated, dominant):
    g = spark.createDataFrame([(w,)], "w array<double>").select(cascade.gate(F.col("w")).alias("g")).first()["g"]
    assert (g["gated"], g["dominant"]) == (gated, dominant)


def test_cascade_against_loop(spark):
    rng = np.random.default_rng(5)
    names = ["alpha", "beta", "gamma", "delta"]
    frame = pd.DataFrame([(q, i, *rng.normal(size=4)) for q in range(6) for i in range(30)],
                         columns=["query_id", "item_id", *[f"score_{e}" for e in names]])
    weights = {0: [.9, .05, .03, .02], 1: [.02, .9, .05, .03], 2: [.03, .02, .9, .05], 3: [.05, .03, .02, .9], 4: [.25] * 4, 5: [.5, .3, .1, .1]}
    sizes = {"alpha": 5, "beta": 5, "gamma": 4, "delta": 6}
    active = {"alpha": [0, 1, 2], "beta": [0, 1, 2], "gamma": [0, 1], "delta": [0, 1, 2]}

    def z(m):
        return (m - m.mean(0)) / (m.std(0) + 1e-8)

    want = {}
    for q, w in weights.items():
        rows = frame[frame.query_id == q].reset_index(drop=True)
        scores = z(rows[[f"score_{e}" for e in names]].to_numpy())
        if q >= 4:
            want.update({(q, i): s for i, s in zip(rows.item_id, scores @ (np.array(w) / (sum(w) + 1e-9)))})
            continue
        top = names[q]
        pool = set(np.argsort(-scores[:, q])[:sizes[top]])
        if q < 2:
            pool |= set(np.argsort(-scores[:, 1 - q])[:sizes[top]])
        pool = sorted(pool)
        inner = z(rows.iloc[pool][[f"score_{e}" for e in names]].to_numpy())
        keep = np.zeros(4)
        keep[active[top]] = np.array(w)[active[top]]
        want.update({(q, rows.item_id[i]): s for i, s in zip(pool, inner @ (keep / (keep.sum() + 1e-9)))})
    weight_rows = spark.createDataFrame([(q, *map(float, w)) for q, w in weights.items()], "query_id long, w_alpha double, w_beta double, w_gamma double, w_delta double")
    got = cascade.route(spark.createDataFrame(frame), weight_rows, pool_size=sizes).collect()
    assert {(r["query_id"], r["item_id"]) for r in got} == set(want)
    assert all(r["score_final"] == pytest.approx(want[r["query_id"], r["item_id"]], abs=1e-6) for r in got)
    assert cascade.route_log(weight_rows).count() == 10
    flat = cascade.route(spark.createDataFrame(frame), weight_rows, use_cascade=False)
    assert flat.count() == 180


def test_embedding_windows(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "id long, text string")
    pieces = texts.select("id", embed.windows(tx.tokens(F.col("text")), 4, 2).alias("w")).where("id = 1").first()["w"]
    assert pieces == [["a", "b", "c", "d"], ["c", "d", "e", "f"], ["e", "f", "g"]]
    vectors = {r["id"]: r["embedding"] for r in embed.embed_hashed(texts, "id", "text", dim=16, window=4, overlap=2).collect()}
    assert np.linalg.norm(vectors[1]) == pytest.approx(1.0, abs=1e-5) and not any(vectors[2]) and len(vectors) == 3

    def load():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    plugged = embed.embed_with(texts, "id", "text", load, 2, "lengths").collect()
    assert {r["embedding_model"] for r in plugged} == {"lengths"} and len(plugged) == 3


def test_emotion_records(spark):
    from tetrarank.sources import readers
    source = spark.createDataFrame([('{"movies": [{"movieId": 1, "title": "A", "Joy": 3, "Fear": 1}, {"movieId": "1", "title": "A", "Joy": 1}, '
                                     '{"id": 2, "scores": [{"label": "rage", "score": 2}]}, {"movieId": 3, "label": "grief"}, {"title": "no id"}]}',)], "value string")
    index = {r["movieId"]: r for r in readers.emotion_index(readers.emotion_records_from_json(source)).collect()}
    assert set(index) == {1, 2, 3} and index[1]["title"] == "A"
    assert index[1]["emo"][0] == pytest.approx(1 / 1.25, abs=1e-6)  # max of (0.75, 1.0) and (0.25, 0), renormalized
    assert index[2]["emo"][5] == pytest.approx(1.0, abs=1e-6) and index[3]["emo"][4] == pytest.approx(1.0, abs=1e-6)
    keyed = spark.createDataFrame([('{"7": {"joy": 1}, "8": {"emotions": {"trust": 2}}}',)], "value string")
    assert {r["movieId"] for r in readers.emotion_index(readers.emotion_records_from_json(keyed)).collect()} == {7, 8}
