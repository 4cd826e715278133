"""Passages of many words that repeat across documents, whatever their length in bytes.

A window of `length` words (A-Z lower-cased, parted by blanks) has one anchor, the run of a quarter as many words in it with
the smallest hash (`anchors`), and equal windows have equal anchors. Runs that occur in one document only are dropped by one
count; of the others, windows are compared in full, by a hash of all their words.

1. A whole stretch of windows at one anchor that two documents have is repeated; nothing of it is compared again.
2. Stretches that one document has are compared window by window with one stretch of each other kind at the same anchor.
3. The windows that two documents have cover the words of the passages.

Counts are added up before they move; no list of occurrences is made, and of a document's places each is gathered once.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm import anchors as an
from tetrarank.llm.common import drop_stored, per_batch, release, small_batches, stored, text_bytes

LISTS = ("gram", "stretch", "first", "last")
FOUND = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), *[(name, pa.list_(pa.int64())) for name in LISTS]])
WINDOWS = pa.schema([(name, pa.int64()) for name in ("key", "key2", "doc_id", "t", "s", "low", "high")] + [("look", pa.bool_())])
RUNS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_passages", pa.int64()), ("n_passage_words", pa.int64()), ("passages", pa.list_(pa.list_(pa.int64())))])
PLACE = ("doc_id", "t", "first", "last")


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.list_(pa.int64())): "array<array<bigint>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    """Per row of (doc_id, t, text) its anchors as parallel lists."""
    def work(batch):
        columns: dict = {name: [] for name in LISTS}
        for data in text_bytes(batch.column(2)):
            hashes = an.WordHashes(data)
            _, gram, first, last = an.anchors_of(hashes, length, length // 4)
            size = last - first + length
            stretch = an.mix(hashes.windows(first, size) + size.astype(np.uint64))
            for name, values in zip(LISTS, (gram.view(np.int64), stretch.view(np.int64), first, last), strict=True):
                columns[name].append(values)
        return {"doc_id": batch.column(0), "t": batch.column(1), **columns}

    return rows.mapInArrow(per_batch(FOUND, work), ddl(FOUND))


def _windows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """One row per window of the wanted stretches: its hash, its place, and between which documents the stretch was met."""
    def run(batches):
        for batch in small_batches(batches, 100):
            parts = []
            for doc_id, t, data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                hashes = an.WordHashes(data)
                first, last, gram = (np.array([p[name] for p in places], np.int64) for name in ("first", "last", "gram"))
                sizes = last - first + 1
                starts = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                own, of = hashes.windows(starts, length), np.repeat(gram, sizes).view(np.uint64)
                parts.append((own.view(np.int64), an.mix(of ^ (own * np.uint64(an.BASE))).view(np.int64), np.full(len(own), t), starts,
                              *[np.repeat(np.array([p[name] for p in places]), sizes) for name in ("low", "high", "look")], [doc_id] * len(own)))
            if parts:
                key, key2, t, s, low, high, look = (np.concatenate([p[i] for p in parts]) for i in range(7))
                ids = [i for p in parts for i in p[7]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((key, key2, ids, t, s, low, high, look), WINDOWS, strict=True)], schema=WINDOWS)

    per_text = wanted.groupBy("doc_id", "t").agg(F.collect_set(F.struct("gram", "first", "last", "low", "high", "look")).alias("places")).select(
        F.col("doc_id").alias("w_doc"), F.col("t").alias("w_t"), "places")
    joined = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("t") == F.col("w_t")))
    return joined.select("doc_id", "t", "text", "places").mapInArrow(run, ddl(WINDOWS))


def runs_of(firsts: list[int], lasts: list[int], length: int) -> list[list[int]]:
    """Maximal runs [start, end) of the words that windows with the given ranges of starts cover."""
    runs: list[list[int]] = []
    for a, z in sorted(zip(firsts, lasts, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z + length)
        else:
            runs.append([a, z + length])
    return runs


def repeated_passages(docs: DataFrame, length: int = 51) -> DataFrame:
    """One row per document and text with a passage: doc_id, t (xxhash64 of the text), n_passages, n_passage_words, passages.

    A word belongs to a passage if `length` words in a row that hold it also occur in another document; passages are maximal
    runs [start, end) of such words, counted from 0. Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; passages never
    cross documents. Null and empty texts and those of fewer words have none and no row. Repeats inside one document are
    none. Rows that repeat an id and a text are one document and one row here; rows that share an id only are two. Extra
    columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = stored(_anchored(rows, length).where(F.size("gram") > 0), "passage-anchors")
    entries = found.select("doc_id", "t", F.explode(F.arrays_zip(*LISTS)).alias("a")).select("doc_id", "t", "a.*")
    document = F.xxhash64("doc_id", "t")
    met = [F.min(document).alias("low"), F.max(document).alias("high")]

    shared = stored(entries.groupBy("gram").agg(*met).where("low < high").select(F.col("gram").alias("s_gram")), "passage-grams")
    alike = stored(entries.join(shared, F.col("gram") == F.col("s_gram")).drop("s_gram"), "passage-shared")
    drop_stored(spark, found, shared)
    release(spark)
    counted = stored(alike.groupBy("gram", "stretch").agg(*met, F.min(F.struct(*PLACE)).alias("one")), "passage-stretches")
    kinds = counted.select(F.col("gram").alias("k_gram"), F.col("stretch").alias("k_stretch"), "low", "high")
    placed = alike.join(kinds, (F.col("gram") == F.col("k_gram")) & (F.col("stretch") == F.col("k_stretch"))).select(*PLACE, "gram", "low", "high")
    placed = stored(placed, "passage-places")
    several = counted.groupBy("gram").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("a < b").select(F.col("gram").alias("m_gram"))
    others = counted.where("low < high").join(several, F.col("gram") == F.col("m_gram")).select("one.*", "gram", "low", "high")
    wanted = stored(placed.where("low = high").withColumn("look", F.lit(True)).unionByName(others.withColumn("look", F.lit(False))), "passage-compared")
    drop_stored(spark, alike, counted)
    release(spark)

    windows = stored(_windows(rows, wanted, length), "passage-windows")
    both = windows.groupBy("key", "key2").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select(
        F.col("key").alias("b_key"), F.col("key2").alias("b_key2"))
    single = windows.where("look").join(both, (F.col("key") == F.col("b_key")) & (F.col("key2") == F.col("b_key2"))).select(
        "doc_id", "t", F.col("s").alias("first"), F.col("s").alias("last"))
    per_text = placed.where("low < high").select(*PLACE).unionByName(single).groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("first", "last")).alias("a")).select("doc_id", "t", F.col("a.first").alias("firsts"), F.col("a.last").alias("lasts"))

    def work(batch):
        runs = [runs_of(a, z, length) for a, z in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return {"doc_id": batch.column(0), "t": batch.column(1), "n_passages": [len(r) for r in runs], "n_passage_words": [sum(z - a for a, z in r) for r in runs], "passages": runs}

    out = stored(per_text.mapInArrow(per_batch(RUNS, work), ddl(RUNS)), "passages")
    drop_stored(spark, placed, wanted, windows)
    release(spark)
    return out


def reference_passages(rows: list[tuple], length: int = 51) -> set[tuple]:
    """(doc_id, n_passages, n_passage_words) of the distinct (doc_id, text) with a passage, by a look at every window, for tests."""
    data = [(i, [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in dict.fromkeys(rows)]
    seen = defaultdict(set)
    for k, (_, words) in enumerate(data):
        for s in range(len(words) - length + 1):
            seen[tuple(words[s:s + length])].add(k)
    out = set()
    for i, words in data:
        inside = {p for s in range(len(words) - length + 1) if len(seen[tuple(words[s:s + length])]) > 1 for p in range(s, s + length)}
        if inside:
            out.add((i, sum(p - 1 not in inside for p in inside), len(inside)))
    return out
