"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed terms. Some describe its form: the shape of each word, repeated words and lines, word lengths;
others what it says: its words, its short words once more, pairs of neighbouring words and of their shapes. Term counts of
a bounded sample of labelled texts, damped, weighted by inverse document frequency and scaled so that both kinds have the
same length, are factored by a truncated singular value decomposition; texts are folded into the space of its
leading right vectors. The labelled vectors are broadcast (rows * dimensions floats, both parameters), each block of
documents is multiplied with all of them, and the labels of the nearest ones vote in proportion to similarity and to how
much rarer their label is in the sample than among all labelled texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import per_batch, texts
from tetrarank.llm.toxicity import remainder, sampled

FORM = 1 << 12  # terms of the form; those of words and pairs come after
TERMS = 1 << 14
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SHAPE = bytes(97 if chr(c).islower() or c >= 128 else 65 if chr(c).isupper() else 48 if chr(c).isdigit() else c for c in range(256))
_RUN = re.compile(rb"(.)\1+")
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Shapes(dict):
    """Word to the hashed terms of its shape and length, the hashes of its shape and of itself without marks around it,
    and the term of a short word or -1; remembered up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, int, int, int, int]:
        if len(self) > 300_000:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))[:12]
        length = min(len(word), 16)
        bare = word.lower().strip(_EDGES) or word
        short = zlib.crc32(b"short " + bare) % FORM if len(bare) < 4 else -1
        value = self[word] = (zlib.crc32(shape) % FORM, zlib.crc32(b"length %d" % length) % FORM, zlib.crc32(shape, 1), zlib.crc32(bare, 2), short)
        return value


def _level(share: float) -> int:
    return min(9, int(10 * share))


def term_counts(text: str, shapes: Shapes) -> dict[int, int]:
    """Counts of the hashed terms of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    row = data.split()
    counted = Counter(row)
    out: dict[int, int] = {}
    words = capitals = marked = 0
    own: dict[bytes, int] = {}
    hashes = np.empty((2, len(counted)), np.uint64)  # of the shape and the word
    for word, n in counted.items():
        shape, length, *both, short = shapes[word]
        hashes[:, len(own)] = both
        own[word] = len(own)
        out[shape] = out.get(shape, 0) + n
        out[length] = out.get(length, 0) + n
        if short >= 0:
            out[short] = out.get(short, 0) + n
        words += n
        capitals += n * (len(word) > 1 and word.isupper())
        marked += n * (not word[-1:].isalnum() and word[-1:] not in (b".", b",") and word[-1] < 128)
    lines = [x for x in data.split(b"\n") if x.strip()]
    whole = {b"repeat": 1 - len(counted) / max(1, words), b"lines": 1 - len(set(lines)) / max(1, len(lines)), b"capitals": capitals / max(1, words),
             b"marks": marked / max(1, words), b"most": max(counted.values(), default=0) / max(1, words)}
    for name, share in whole.items():  # a level weighs as much as a fifth of the words
        key = zlib.crc32(name + b" %d" % _level(share)) % FORM
        out[key] = out.get(key, 0) + max(1, words // 5)
    size = zlib.crc32(b"size %d" % min(20, words.bit_length())) % FORM
    out[size] = out.get(size, 0) + max(1, words // 20)
    if row:
        shaped, said = hashes[:, np.fromiter(map(own.__getitem__, row), np.int64, len(row))]
        mixed = np.concatenate([said * STEPS[0], said[:-1] * STEPS[0] + said[1:] * STEPS[1], shaped[:-1] * STEPS[1] + shaped[1:] * STEPS[0] + np.uint64(1)])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * STEPS[1]
        found = np.bincount(((mixed >> np.uint64(32)) % np.uint64(TERMS - FORM)).astype(np.int64), minlength=TERMS - FORM)
        at = np.flatnonzero(found)
        out.update(zip((at + FORM).tolist(), found[at].tolist(), strict=True))
    return out


def _weights(indices: np.ndarray, counts: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, idf-weighted counts: form and words of each text scaled to the same length, both together to length one."""
    w = np.sqrt(counts) * idf[indices]
    row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    kind = 2 * row + (indices >= FORM)
    norm = np.sqrt(np.bincount(kind, weights=w * w, minlength=2 * len(ends)))
    kinds = np.sqrt((norm.reshape(-1, 2) > 0).sum(axis=1))
    return w / np.maximum(norm[kind] * kinds[row], 1e-12)


def _flat(bags: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, counts and ends of bags, which are dicts or pairs of arrays."""
    if bags and isinstance(bags[0], tuple):
        terms, counts = zip(*bags, strict=True)
        return np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64), np.cumsum([len(t) for t in terms], dtype=np.int64)
    indices = np.array([k for b in bags for k in b], np.int64)
    counts = np.array([v for b in bags for v in b.values()], np.float64)
    return indices, counts, np.cumsum([len(b) for b in bags], dtype=np.int64)


class Space:
    """Latent space with labelled vectors."""

    def __init__(self, bags: list, labels: np.ndarray, dimensions: int = 32, seed: int = 0, weights: np.ndarray | None = None):
        self.labels = labels.astype(np.float32)
        self.weights = np.ones(len(labels), np.float32) if weights is None else weights.astype(np.float32)
        indices, counts, ends = _flat(bags)
        self.idf = np.log((1 + len(bags)) / (1 + np.bincount(indices, minlength=TERMS))) + 1.0
        full = np.zeros((len(bags), TERMS), np.float32)
        row = np.repeat(np.arange(len(bags)), np.diff(np.concatenate([[0], ends])))
        full[row, indices] = _weights(indices, counts, ends, self.idf)
        rng = np.random.default_rng(seed)
        k = min(dimensions, len(bags))
        basis = np.linalg.qr(full.T @ rng.standard_normal((len(bags), min(len(bags), k + 10))).astype(np.float32))[0]
        for _ in range(4):  # subspace iteration
            basis = np.linalg.qr(full.T @ (full @ basis))[0]
        small = np.linalg.svd(full @ basis, full_matrices=False)[2]
        self.axes = np.ascontiguousarray((basis @ small.T)[:, :k].astype(np.float32))
        self.vectors = self._unit(full @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def fold(self, bags: list[dict[int, int]]) -> np.ndarray:
        indices, counts, ends = _flat(bags)
        w = _weights(indices, counts, ends, self.idf).astype(np.float32)
        out = np.add.reduceat(self.axes[indices] * w[:, None], np.concatenate([[0], ends[:-1]]), axis=0) if len(indices) else np.zeros((len(bags), self.axes.shape[1]))
        return self._unit(out)

    def vote(self, vectors: np.ndarray, neighbours: int = 15, power: int = 8, block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of their cosine and their own weight."""
        k = min(neighbours, len(self.labels))
        out = np.empty(len(vectors))
        for at in range(0, len(vectors), block):
            cosine = vectors[at:at + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** power * self.weights[near]
            out[at:at + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)

    def score(self, batch: list[str], shapes: Shapes) -> np.ndarray:
        return self.vote(self.fold([term_counts(t, shapes) for t in batch]))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2, most: int = 3000, dimensions: int = 32) -> Space | None:
    """Space of at most `most` labelled texts, half of each label, whose crc32(doc_id) modulo `modulus` is not `out`.

    The vectors of a label together weigh as much as the label's share of all labelled texts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("t_id"), F.col("quality").cast("int").alias("quality")).where(
        (remainder("t_id", modulus) != out) & F.col("quality").isNotNull()).groupBy("t_id").agg(F.max("quality").alias("quality"))
    schema = pa.schema([("doc_id", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def work(batch):
        bags = [term_counts(t, Shapes()) for t in texts(batch.column(1))]
        return {"doc_id": batch.column(0), "terms": [np.array(list(b), np.int32).tobytes() for b in bags],
                "counts": [np.array(list(b.values()), np.int32).tobytes() for b in bags]}

    total = {r.quality: r["count"] for r in rows.where("quality in (0, 1)").groupBy("quality").count().collect()}
    bags, marks, weights = [], [], []
    for label in (0, 1):  # half of the sample from each label
        chosen = sampled(rows.where(F.col("quality") == label), docs, most // 2)
        got = chosen.select("doc_id", "text").mapInArrow(per_batch(schema, work), "doc_id bigint, terms binary, counts binary").collect()
        own = [(np.frombuffer(r.terms, np.int32), np.frombuffer(r.counts, np.int32)) for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.terms)))]
        bags += own
        marks += [label] * len(own)
        weights += [total[label] / sum(total.values()) / len(own) for _ in own]
    return Space(bags, np.array(marks), dimensions, weights=len(bags) * np.array(weights)) if bags else None


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7).

    Learned without labels of the documents whose crc32(doc_id as text) modulo 4 is 2; those are held out. Only the whole
    text makes a score. Null counts as empty; texts without words have a vector of their own (no repeats, no marks). Without
    labels every score is 0.5. A null doc_id counts as held out. An empty table gives an empty result.
    """
    space = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(space)  # most * dimensions + TERMS * dimensions floats

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for column in parts:
            scores = [shared.value.score([t or "" for t in column.iloc[at:at + 100]], shapes) if shared.value else np.full(len(column.iloc[at:at + 100]), 0.5)
                      for at in range(0, len(column), 100)]
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    score = F.pandas_udf(of, "double")(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
