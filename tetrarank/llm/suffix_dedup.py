"""Long repeated strings, found through a logarithmic family of tables of anchored grams.

There is no suffix array here: in its place stands a hash index, since only repeats of `length` bytes and more are asked for, for which equal
grams are enough, and suffix order would move and sort the bytes of all suffixes. Grams are taken at content-defined anchors
(`anchors`): each window of `length` bytes has one, and equal windows have equal ones, so no repeat is missed.

1. `IndexFamily`: a batch of documents becomes a table of its anchored grams (first eight bytes and a hash of 250), equal ones
   counted together. A join on the hash with each level that exists gives the grams that also occur elsewhere. Then the table
   is a level itself; two levels of the same rank merge into one of the next rank, so n batches leave about log2(n) levels and
   each gram is merged as often. The levels serve the batches of one call.
2. Windows at shared grams are compared in full. An anchor stands for a run of window starts; where the whole
   stretch of its windows occurs twice, all of them are repeated. Where one gram has several stretches, one anchor
   of each compares its windows one by one, by their hashes.
3. Repeated windows cover the bytes to be removed.

Beside them the passages of many words that repeat across documents are marked (`passages`), as those need not have `length` bytes.

What is shared by many texts is counted by partial aggregation before it moves; no list of occurrences is made. Texts
move once, and only those with a shared beginning are kept for the later steps.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrarank.llm import anchors as an
from tetrarank.llm.common import drop_stored, release, small_batches, stored, text_bytes
from tetrarank.llm.passages import repeated_passages, runs_of

FOUND = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()),
                   *[(name, pa.list_(pa.int64())) for name in ("head", "gram", "stretch", "at", "first", "last")]])
ANCHORS = ("doc_id bigint, t bigint, n_bytes bigint, sha256 string, head array<bigint>, gram array<bigint>, stretch array<bigint>, at array<bigint>, "
           "first array<bigint>, last array<bigint>")
SUFFIX = ["head", "gram"]


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """Per row of (doc_id, t, text): size, digest, and its anchors as parallel lists."""

    def run(batches):
        for batch in small_batches(batches, 200):
            columns: dict[str, list] = {f.name: [] for f in FOUND}
            for data in text_bytes(batch.column(2)):
                at, gram, first, last = an.anchors(data, length, an.Hashes(data) if len(data) >= length else None)
                columns["n_bytes"].append(len(data))
                columns["sha256"].append(hashlib.sha256(data).hexdigest())
                columns["head"].append([int.from_bytes(data[p:p + 8], "big") - (1 << 63) for p in at.tolist()])
                columns["gram"].append(gram.view(np.int64))
                columns["stretch"].append([an.digest(data[a:z + length]) for a, z in zip(first.tolist(), last.tolist(), strict=True)])
                columns["at"].append(at)
                columns["first"].append(first)
                columns["last"].append(last)
            columns["doc_id"], columns["t"] = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in FOUND], schema=FOUND)

    return docs.mapInArrow(run, ANCHORS)


class IndexFamily:
    """Levels of sorted suffixes, each a stored table (head, gram, n); a level of rank r holds 2^r batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []

    def insert(self, suffixes: DataFrame) -> DataFrame:
        """Take in a batch of suffixes (head, gram, ...) and return the distinct ones that occur twice or more by now,
        of which at least one is in the batch."""
        array = stored(suffixes.groupBy(*SUFFIX).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*SUFFIX), "suffix-array")
        shared = array.where("n > 1").select(*SUFFIX)
        for _, level in self.levels:
            shared = shared.unionByName(array.select(*SUFFIX).join(level.select(*SUFFIX), SUFFIX))
        found = stored(shared.distinct(), "shared-suffixes")
        self.levels.append((0, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy(*SUFFIX).agg(F.sum("n").alias("n")).sortWithinPartitions(*SUFFIX)
            self.levels.append((rank + 1, stored(merged, "suffix-level")))
            drop_stored(self.spark, a, b)
        release(self.spark)
        return found


def _compared(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """One row per window of the wanted anchors: key, key2, doc_id, t, s, alone."""
    schema = pa.schema([("key", pa.int64()), ("key2", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("alone", pa.bool_())])

    def run(batches):
        for batch in small_batches(batches, 100):
            parts = []
            grams, firsts, lasts, alones = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            for k, (doc_id, t, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True)):
                first, last = np.array(firsts[k], np.int64), np.array(lasts[k], np.int64)
                sizes = last - first + 1
                starts = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                own = an.Hashes(data).windows(starts, length)
                gram = np.repeat(np.array(grams[k], np.int64).view(np.uint64), sizes)
                key = an.mix(own + gram * np.uint64(an.BASE))
                parts.append((key.view(np.int64), (an.mix(gram ^ own) >> np.uint64(33)).astype(np.int32), doc_id, t, starts, np.repeat(np.array(alones[k], bool), sizes)))
            if parts:
                n = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts])),
                    pa.array([p[2] for p, m in zip(parts, n, strict=True) for _ in range(m)], pa.int64()), pa.array(np.repeat([p[3] for p in parts], n)),
                    pa.array(np.concatenate([p[4] for p in parts])), pa.array(np.concatenate([p[5] for p in parts]))], schema=schema)

    per_text = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("gram", "first", "last", "alone")).alias("a")).select(
        F.col("doc_id").alias("w_doc"), F.col("t").alias("w_t"), F.col("a.gram").alias("gram"), F.col("a.first").alias("first"), F.col("a.last").alias("last"), F.col("a.alone").alias("alone"))
    joined = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("t") == F.col("w_t")))
    return joined.select("doc_id", "t", "text", "gram", "first", "last", "alone").mapInArrow(run, "key bigint, key2 int, doc_id bigint, t bigint, s bigint, alone boolean")


RESULT = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                    ("spans", pa.list_(pa.list_(pa.int64())))])


def _removed(batches, length: int):
    for batch in small_batches(batches, 200):
        rows = []
        for doc_id, t, data, a, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)),
                                         batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            runs = runs_of(a, z, length)
            edges = [0, *[e for r in runs for e in r], len(data)]
            kept = b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((doc_id, t, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def repeated_spans(docs: DataFrame, length: int = 400, batches: int = 4, passage_words: int = 51) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs [start, end) of bytes),
    n_passages, n_passage_words, passages (runs of words, see `passages.repeated_passages`).

    A byte is removed if a string of `length` bytes that covers it also begins anywhere else, in the same document or
    another. Texts are UTF-8 bytes, null counts as empty, matches never cross documents, texts under `length` bytes keep
    everything. Rows that repeat an id and a text repeat each other and so are removed; rows that share an id only are told
    apart by their texts. Passages are marked only: `passage_words` words that occur in another document, too, which may
    have fewer bytes than `length`. Extra columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")
    passages = repeated_passages(docs, passage_words).withColumnsRenamed({"doc_id": "p_doc", "t": "p_t"})
    found = stored(anchored(rows, length), "anchors")
    about = stored(found.select("doc_id", "t", "n_bytes", "sha256"), "texts-about")
    entries = found.select("doc_id", "t", F.explode(F.arrays_zip("head", "gram", "stretch", "first", "last")).alias("a")).select("doc_id", "t", "a.*")

    family = IndexFamily(spark)
    shared = None
    for b in range(batches):
        new = family.insert(entries.where(F.pmod(F.xxhash64("doc_id", "t"), F.lit(batches)) == b))
        shared = new if shared is None else shared.unionByName(new)
    # Stored, so that Spark can split the rows of a beginning that very many suffixes have.
    beginnings = stored(shared.select(F.col("gram").alias("s_gram")).distinct(), "beginnings")
    alike = stored(entries.drop("head").join(beginnings, F.col("gram") == F.col("s_gram")).select("doc_id", "t", "gram", "stretch", "first", "last"), "shared-anchors")
    drop_stored(spark, found, *[level for _, level in family.levels])
    release(spark)

    counted = stored(alike.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "first", "last")).alias("one")), "stretches")
    several = counted.groupBy("gram").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("low < high").select(F.col("gram").alias("m_gram"))
    wanted = stored(counted.join(several, F.col("gram") == F.col("m_gram")).select("one.*", "gram", (F.col("n") == 1).alias("alone")), "compared")
    whole = stored(alike.join(counted.where("n > 1").select(F.col("gram").alias("c_gram"), F.col("stretch").alias("c_stretch")),
                              (F.col("gram") == F.col("c_gram")) & (F.col("stretch") == F.col("c_stretch"))).select("doc_id", "t", "first", "last"), "repeated-stretches")
    drop_stored(spark, alike, counted)
    release(spark)

    needed = wanted.select("doc_id", "t").unionByName(whole.select("doc_id", "t")).distinct().select(F.col("doc_id").alias("n_doc"), F.col("t").alias("n_t"))
    texts = stored(rows.join(needed, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("t") == F.col("n_t"))).select("doc_id", "t", "text").dropDuplicates(["doc_id", "t"]), "shared-texts")
    release(spark)

    # The windows are made twice, once to count and once to look up, so that each shuffle is gone before the next.
    windows = _compared(texts, wanted, length)
    twice = stored(windows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("t_key"), F.col("key2").alias("t_key2")), "windows")
    release(spark)
    single = windows.where("alone").drop("alone").join(twice, (F.col("key") == F.col("t_key")) & (F.col("key2") == F.col("t_key2"))).select(
        "doc_id", "t", F.col("s").alias("first"), F.col("s").alias("last"))
    ranges = whole.unionByName(stored(single, "repeated-windows"))
    release(spark)
    per_text = ranges.groupBy("doc_id", "t").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")).select(
        F.col("doc_id").alias("r_doc"), F.col("t").alias("r_t"), "firsts", "lasts")
    cut = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("t") == F.col("r_t"))).select("doc_id", "t", "text", "firsts", "lasts").mapInArrow(
        lambda b: _removed(b, length), "doc_id bigint, t bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")
    cut = cut.select(F.col("doc_id").alias("k_doc"), F.col("t").alias("k_t"), "n_removed", "n_spans", "kept_sha256", "spans")
    joined = about.join(cut, F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("t") == F.col("k_t")), "left")
    joined = joined.join(passages, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("t") == F.col("p_t")), "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<array<bigint>>")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                         F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("spans", none).alias("spans"),
                         F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_passage_words", zero).alias("n_passage_words"), F.coalesce("passages", none).alias("passages"))


def reference_removal(rows: list[tuple], length: int = 400) -> set[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every window of (doc_id, text), for tests."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hashlib.blake2b(b[s:s + length], digest_size=16).digest() for _, b in data for s in range(len(b) - length + 1))
    out = set()
    for i, b in data:
        starts = [s for s in range(len(b) - length + 1) if seen[hashlib.blake2b(b[s:s + length], digest_size=16).digest()] > 1]
        gone = set()
        for s in starts:
            gone.update(range(s, s + length))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        out.add((i, len(b), len(gone), sum(1 for k in gone if k - 1 not in gone), hashlib.sha256(kept).hexdigest()))
    return out
