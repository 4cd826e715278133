"""Ids, languages and alphabets that a sample, a block or a table must not depend on."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.llm import fingerprints, language_id, toxicity


def test_sample_takes_one_text_per_id(spark):
    docs = spark.range(100_000).select(F.when(F.col("id") < 99_000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    ids = docs.select(F.col("doc_id").alias("t_id"))
    got = toxicity.sampled(ids, docs, 2000).collect()
    assert len(got) == len({r.doc_id for r in got}) == 1001
    assert len(toxicity.sampled(ids.where("t_id = 7"), docs, 5).collect()) == 1


def test_first_ids_by_hash_of_each_group(spark):
    rows = spark.range(30_000).select(F.col("id").alias("t_id"), F.when(F.col("id") < 29_990, "big").otherwise("small").alias("lang"))
    got = toxicity.first_by_hash(rows.union(rows), 20, "lang").collect()
    assert len(got) == len(set(got)) < 1000 and sum(r.lang == "small" for r in got) == 10
    best = [r.t_id for r in rows.where("lang = 'big'").orderBy(F.xxhash64("t_id")).limit(20).collect()]
    assert set(best) <= {r.t_id for r in got}
    assert toxicity.first_by_hash(rows.limit(0), 20).count() == toxicity.first_by_hash(rows.limit(0), 20, "lang").count() == 0


def test_table_of_large_alphabets_follows_the_text():
    rng = random.Random(2)
    samples = {f"z{k}": "".join(chr(0x4E00 + 4000 * k + rng.randrange(4000)) for _ in range(12_000)) for k in range(3)}
    languages = language_id.Languages(samples)
    table = languages.edges
    assert table.keys.nbytes + table.targets.nbytes <= 3 * 12_000 * 3 * 8 * 12
    texts = [samples["z1"][400:900], "".join(rng.sample(samples["z0"], 200)), "abc", chr(0x10FFFF)]
    assert languages.phrases(texts).tolist() == [[language_id.reference_phrases(t, samples[n]) for n in languages.names] for t in texts]
    assert languages.predict(texts[:2])[0] == ["z1", "z0"]


@pytest.mark.parametrize("blocks", [1, 8, 40])
def test_edits_where_many_rows_share_an_id(spark, blocks):
    """Null ids fill several blocks; the order is the same for any number of blocks."""
    rows = [(None, f"null {i} " * 5) for i in range(60)] + [(9, f"nine {i}") for i in range(25)] + [(i, f"own text {i} of them") for i in range(20, 50)] + [(9, "nine 3")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints.edited_likeness(docs, blocks).collect())
    ordered = [(r.doc_id, r.text) for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()]
    want = []
    for at, (i, t) in enumerate(ordered):
        k = len(t) // 4
        want.append((str(i), hashlib.sha256((t[:len(t) - k] + ordered[(at + 1) % len(ordered)][1][:k]).encode()).hexdigest()))
    assert got == sorted(want)


def test_an_id_of_many_rows_has_several_blocks():
    bounds = np.array([1, 5, 5, 5, 9])
    hashes = np.array([-(1 << 63), -1, (1 << 63) - 1, 0, 0, 0], np.int64)
    assert fingerprints._block(bounds, np.array([5, 5, 5, 0, 7, 9]), hashes).tolist() == [2, 3, 4, 0, 4, 5]


@pytest.mark.parametrize("words, clear", [([1, 2, 3, 4, 5, 6, 7], True), ([1, 3, 5, 6, 7], False)])
def test_classifier_minimises_the_corrected_risk(words, clear):
    """Where the risk on unseen negatives stays clear of zero, the fit is a stationary point of the stated risk, by differences;
    where it could be driven below zero, the fit stops there."""
    rng = np.random.default_rng(4)
    positive = [np.unique(rng.choice([1, 2, 3, 4], 2)).astype(np.uint32) for _ in range(40)]
    unlabelled = [np.unique(rng.choice(words, 3)).astype(np.uint32) for _ in range(120)]
    chosen, prior, decay = np.arange(1, 8).astype(np.uint32), 0.1, 0.02
    model = toxicity.fit(positive, unlabelled, prior, chosen, steps=4000, rate=0.01, decay=decay)

    def risks(w):
        gp, gu = (np.array([w[-1] + sum(w[int(f) - 1] for f in s) for s in group]) for group in (positive, unlabelled))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return prior * np.logaddexp(0, -gp).mean() + max(0.0, rest) + decay / 2 * (w[:-1] ** 2).sum(), rest

    at = np.array([*[model.weights[int(f)] for f in chosen], model.bias])
    slope = [(risks(at + step)[0] - risks(at - step)[0]) / 2e-4 for step in np.eye(8) * 1e-4]
    if clear:
        assert risks(at)[1] > 0.05 and np.abs(slope).max() < 1e-6
    else:
        assert abs(risks(at)[1]) < 0.005
