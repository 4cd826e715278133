"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (lines). Every paragraph is hashed to a wide vector, and the vectors of a text are
summed lane by lane modulo a power of two, so the order of paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (`combine`). The vector has two parts:

* 16 lanes modulo 2^64, a SHAKE-256 digest of the paragraph: equal sums mean equal multisets, but for collisions;
* 256 lanes modulo 2^32, a signed count of the word triples inside the paragraph (shorter paragraphs: all of it): sums
  of such lanes keep inner products up to a few hundredths, so two fingerprints alone tell how much texts share.

Likeness is 2 <x, y> / (<x, x> + <y, y>) over the second part, clipped to 0..1; equal fingerprints give 1.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import small_batches, tasks_for, texts

WIDE, SKETCH = 16, 256
BLOCK_ROWS = 200_000  # rows of a block of neighbouring ids
RUN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class WordHashes(dict):
    """Word to 64-bit hash, remembered. Emptied when large, which bounds memory and changes no value."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = _hash(word)
        return value


def _sums(data: bytes, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of the paragraphs of `data`, all at once."""
    paragraphs = data.split(b"\n")
    wide = np.frombuffer(b"".join([hashlib.shake_256(p).digest(8 * WIDE) for p in paragraphs]), np.uint64).reshape(-1, WIDE).sum(axis=0)
    words = [p.split() for p in paragraphs]
    sizes = np.array([len(w) for w in words])
    short = np.array([_hash(p) for p, w in zip(paragraphs, words, strict=True) if len(w) < 3], np.uint64)
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    inside = np.ones(len(h), bool)  # a triple begins here and ends in the same paragraph
    ends = np.cumsum(sizes)
    inside[ends[sizes > 0] - 1] = False
    inside[ends[sizes > 1] - 2] = False
    at = np.flatnonzero(inside)
    marks = _mix(np.concatenate([h[at] * RUN[0] + h[at + 1] * RUN[1] + h[at + 2] * RUN[2], short]) if len(at) else short)
    sign = ((marks >> np.uint64(63)).astype(np.int64) << 1) - 1
    return wide, np.bincount((marks & np.uint64(SKETCH - 1)).astype(np.int64), weights=sign, minlength=SKETCH).astype(np.int64)


class Fingerprint:
    """Sum of paragraph vectors. The empty text has no paragraph and all lanes zero."""

    def __init__(self, wide: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide
        self.sketch = np.zeros(SKETCH, np.int64) if sketch is None else sketch

    def add(self, paragraphs: bytes, known: WordHashes) -> Fingerprint:
        wide, sketch = _sums(paragraphs, known)
        return Fingerprint(self.wide + wide, self.sketch + sketch)

    def remove(self, paragraphs: bytes, known: WordHashes) -> Fingerprint:
        wide, sketch = _sums(paragraphs, known)
        return Fingerprint(self.wide - wide, self.sketch - sketch)

    def lanes(self) -> np.ndarray:
        return self.sketch.astype(np.int32)

    def text(self) -> str:
        return base64.b64encode(self.wide.tobytes() + self.lanes().tobytes()).decode()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fingerprint_of(text: str, known: WordHashes | None = None) -> Fingerprint:
    return Fingerprint().add(utf8(text), WordHashes() if known is None else known) if text else Fingerprint()


def edit(text: str, following: str, mark: Fingerprint, known: WordHashes) -> tuple[str, Fingerprint]:
    """The text with its last quarter replaced by the start of the following one, and its fingerprint.

    The fingerprint comes from that of the text by deleting and inserting the paragraphs from the cut on.
    """
    quarter = len(text) // 4
    cut = len(text) - quarter
    edited = text[:cut] + following[:quarter]
    if edited == text:
        return edited, mark
    start = text.rfind("\n", 0, cut) + 1
    return edited, mark.remove(utf8(text[start:]), known).add(utf8(edited[start:]), known)


def _lanes(fingerprint: str) -> tuple[bytes, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return raw[:8 * WIDE], np.frombuffer(raw, np.int32, offset=8 * WIDE).astype(np.float64)


def likeness(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> float:
    """Share in common of two fingerprints' word triples, estimated from the sums alone."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    size = a[1] @ a[1] + b[1] @ b[1]
    return float(min(1.0, max(0.0, 2.0 * (a[1] @ b[1]) / size))) if size else 0.0


def combine(left: str, right: str, sign: int = 1) -> str:
    """Fingerprint of the multiset sum (1) or difference (-1): inserts or deletes paragraphs without the text."""
    (a, x), (b, y) = _lanes(left), _lanes(right)
    wide = np.frombuffer(a, np.uint64) + (np.frombuffer(b, np.uint64) if sign > 0 else np.uint64(0) - np.frombuffer(b, np.uint64))
    return base64.b64encode(wide.tobytes() + (x + sign * y).astype(np.int64).astype(np.int32).tobytes()).decode()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with a fingerprint column; null text counts as empty."""

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        known = WordHashes()
        return column.map(lambda t: fingerprint_of(t or "", known).text())

    return docs.withColumn(out, of(F.col(text).cast("string")))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _block(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of the block of each id; an id that is a bound more than once has as many blocks, by ranges of the text's hash."""
    low, high = (np.searchsorted(bounds, ids, side=side) for side in ("left", "right"))
    part = np.floor((hashes / 2.0 ** 64 + 0.5) * (high - low)).astype(np.int64)
    return np.where(high > low, low + 1 + np.minimum(part, high - low - 1), high)


def _blocks(rows: DataFrame, count: int) -> tuple[np.ndarray, bool, list[tuple]]:
    """Bounds of `count` blocks of ascending ids, whether one id fills several of them, and (block, id, hash) of the first row of
    every block that has one. Texts are read and hashed only where an id fills several; else the hash counts as 0."""
    shares = [i / count for i in range(1, count)]
    found = rows.agg(F.percentile_approx("order", shares, max(10_000, 4 * count))).first()[0] if shares else []
    bounds = np.array([x for x in found or [] if x is not None], np.int64)
    hot = len(np.unique(bounds)) < len(bounds)
    block = F.pandas_udf(lambda c, h: pd.Series(_block(bounds, c.to_numpy(), h.to_numpy())), "long")
    keys = rows.select("order", (F.xxhash64("text") if hot else F.lit(0).cast("long")).alias("h"))
    starts = keys.groupBy(block("order", "h").alias("block")).agg(F.min(F.struct("order", "h")).alias("start")).collect()
    return bounds, hot, sorted((r.block, *r.start) for r in starts)


def edited_likeness(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending doc_id; after the last comes the first. A single document follows itself. Rows with equal ids
    follow each other in the order of xxhash64 of their texts, then of the texts; null ids come first, null text counts as
    empty. An empty table gives an empty result.

    Documents are dealt to blocks of neighbouring ids, whose number follows the rows, and read in order there, so each text
    is shuffled and hashed once; a copy of the first document of each block also goes to the block before it. An id that
    many rows share, or null, is dealt to several blocks by ranges of the hash; only rows that repeat id and text stay
    together. A block is sorted by Spark and read as a stream.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63))))
    count = blocks or tasks_for(spark, rows.count(), BLOCK_ROWS)
    bounds, hot, starts = _blocks(rows, count)
    before = {(o, h): starts[i - 1][0] for i, (_, o, h) in enumerate(starts)}  # the block before the one that begins here

    @F.pandas_udf("array<long>")
    def places(column: pd.Series, hashes: pd.Series) -> pd.Series:
        own = _block(bounds, column.to_numpy(), hashes.to_numpy()).tolist()
        return pd.Series([[b] if key not in before else [b, -1 - before[key]] for key, b in zip(zip(column.tolist(), hashes.tolist(), strict=True), own, strict=True)])

    hashed = rows.withColumn("h", F.xxhash64("text"))
    dealt = hashed.withColumn("place", F.explode(places("order", F.col("h") if hot else F.lit(0).cast("long")))).select(
        "doc_id", "text", "order", "h", (F.col("place") < 0).alias("guest"),
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"))
    ordered = dealt.repartition(count, "block").sortWithinPartitions("block", "guest", "order", "h", "text")
    return ordered.select("block", "guest", "doc_id", "text").mapInArrow(_in_order, "doc_id bigint, n_chars bigint, edited_sha256 string, "
                                                                         "fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _in_order(batches):
    """Rows of a block in order, then the guest that follows its last row: each row waits for the next one."""
    known = WordHashes()
    out: list[tuple] = []
    held = None  # block, id, text, fingerprint

    def row(own, text, mark):
        edited, changed = edit(own[2], text, own[3], known)
        mine, theirs, other = (_parts(x) for x in (own[3], changed, mark))
        return (own[1], len(own[2]), hashlib.sha256(utf8(edited)).hexdigest(), own[3].text(), changed.text(),
                likeness(mine, theirs), likeness(mine, other))

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)
        out.clear()
        return batch

    for batch in small_batches(batches):
        for block, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts(batch.column(3)), strict=True):
            if held is None and guest:
                continue  # a further guest of the same id
            mark = fingerprint_of(text, known)
            if held is not None and (held[0] == block):
                out.append(row(held, text, mark))
                held = None
            if not guest:
                held = (block, doc_id, text, mark)
        if len(out) >= 500:
            yield flush()
    if out:
        yield flush()


def _parts(mark: Fingerprint) -> tuple[bytes, np.ndarray]:
    return mark.wide.tobytes(), mark.lanes().astype(np.float64)


def reference_edits(rows: list[tuple]) -> dict:
    """(edited sha256, n_chars) by a plain loop over (doc_id, text) with distinct ids, for tests."""
    ordered = sorted((i, t or "") for i, t in rows)
    out = {}
    for at, (i, t) in enumerate(ordered):
        nxt = ordered[(at + 1) % len(ordered)][1]
        k = len(t) // 4
        out[i] = (hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest(), len(t))
    return out
