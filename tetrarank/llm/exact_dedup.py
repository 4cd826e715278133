"""Exact duplicates by an index of live digests in cuckoo filters over bucketed content.

Digests are dealt to buckets by their leading bits. A bucket keeps its content (digest, number of live rows, row that
stays) and a cuckoo filter over it. A digest that the filter does not know is new; one it seems to know is compared with
the content of its bucket, so a false hit never merges texts. A filter that overflows is rebuilt twice as large from the
stored digests. Deleting the last row of a digest takes it out of filter and content.

Rows with equal digests are combined inside each batch before the shuffle, so a text that a third of all rows share sends
one row per batch to its bucket. Only ids and digests are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import per_batch, stored, tasks_for, text_bytes

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Set of 32-byte digests with deletion: two candidate buckets of four 16-bit fingerprints each."""

    def __init__(self, buckets: int = 16):
        self.size = 1 << max(1, int(buckets - 1).bit_length())
        self.cells = array("H", bytes(2 * SLOTS * self.size))

    @staticmethod
    def _fingerprint(digest: bytes) -> int:
        return (digest[8] << 8 | digest[9]) or 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark, first = self._fingerprint(digest), int.from_bytes(digest[10:18], "big") & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & (self.size - 1))

    def _put(self, place: int, mark: int) -> bool:
        for cell in range(SLOTS * place, SLOTS * place + SLOTS):
            if not self.cells[cell]:
                self.cells[cell] = mark
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.cells[SLOTS * a:SLOTS * a + SLOTS] or mark in self.cells[SLOTS * b:SLOTS * b + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False when no place was found; the filter is then to be rebuilt from the stored digests."""
        mark, a, b = self._places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        place = b
        for kick in range(MAX_KICKS):
            cell = SLOTS * place + kick % SLOTS
            mark, self.cells[cell] = self.cells[cell], mark
            place = self._other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        mark, a, b = self._places(digest)
        for place in (a, b):
            for cell in range(SLOTS * place, SLOTS * place + SLOTS):
                if self.cells[cell] == mark:
                    self.cells[cell] = 0
                    return


class LiveDigests:
    """One bucket of the index: filter and content."""

    def __init__(self, filter_buckets: int = 16):
        self.filter = CuckooFilter(filter_buckets)
        self.content: dict[bytes, list[int]] = {}

    def insert(self, digest: bytes, keep: int | None, rows: int = 1) -> bool:
        """True when the digest is new. `keep` is the largest id among the rows, None for null ids."""
        known = self.content.get(digest) if digest in self.filter else None
        if known is not None:
            known[0] += rows
            if keep is not None and (known[1] is None or keep > known[1]):
                known[1] = keep
            return False
        self.content[digest] = [rows, keep]
        if not self.filter.insert(digest):
            self._rebuild()
        return True

    def delete(self, digest: bytes, rows: int = 1) -> bool:
        """Take rows of a digest out; True when that was the last one. Unknown digests change nothing."""
        known = self.content.get(digest) if digest in self.filter else None
        if known is None:
            return False
        known[0] -= rows
        if known[0] > 0:
            return False
        del self.content[digest]
        self.filter.delete(digest)
        return True

    def _rebuild(self) -> None:
        size = self.filter.size
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(d) for d in self.content):
                return


KEYED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
PART = pa.schema([("digest", pa.binary()), ("rows", pa.int64()), ("keep_id", pa.int64())])
STATE = "bucket int, digest binary, rows bigint, keep_id bigint"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, SHA-256 of the whole text with A-Z lowered); null text counts as empty."""

    def work(batch):
        return {"doc_id": batch.column(0), "digest": [hashlib.sha256(t.lower()).digest() for t in text_bytes(batch.column(1))]}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        per_batch(KEYED, work), "doc_id bigint, digest binary")


def _combined(keyed: DataFrame) -> DataFrame:
    """Rows of equal digests of a batch put together: digest, number of rows, largest id."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seen: dict[bytes, list] = {}
            for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = seen.setdefault(d, [0, i])
                known[0] += 1
                if i is not None and (known[1] is None or i > known[1]):
                    known[1] = i
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                              pa.array([v[1] for v in seen.values()], pa.int64())], schema=PART)

    return keyed.select("doc_id", "digest").mapInArrow(run, "digest binary, rows bigint, keep_id bigint")


def _bucketed(parts: DataFrame, buckets: int):
    return parts.withColumn("bucket", (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % buckets).cast("int"))


def _content(bucket: int, live: LiveDigests) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket] * len(live.content), pa.int32()), "digest": pa.array(list(live.content), pa.binary()),
                     "rows": pa.array([v[0] for v in live.content.values()], pa.int64()),
                     "keep_id": pa.array([v[1] for v in live.content.values()], pa.int64())})


def _load(rows: pa.Table, live: LiveDigests) -> LiveDigests:
    for d, n, keep in zip(*(rows.column(c).to_pylist() for c in ("digest", "rows", "keep_id")), strict=True):
        live.insert(d, keep, n)
    return live


def build_index(keyed: DataFrame, buckets: int) -> DataFrame:
    """Content of the index over (doc_id, digest) rows: bucket, digest, live rows, the row that stays."""

    def insert(key, rows):
        return _content(key[0].as_py(), _load(rows, LiveDigests()))

    return _bucketed(_combined(keyed), buckets).groupBy("bucket").applyInArrow(insert, STATE)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame, buckets: int) -> DataFrame:
    """The index after inserting and then deleting (doc_id, digest) rows.

    `keep_id` stays that of the live digest's largest id ever inserted; recompute it from the live documents where the
    kept row itself was deleted. Deleting what is not live changes nothing.
    """
    changes = _bucketed(_combined(inserted), buckets).withColumn("sign", F.lit(1)).unionByName(
        _bucketed(_combined(deleted), buckets).withColumn("sign", F.lit(-1)))

    def change(key, old, new):
        live = _load(old, LiveDigests(max(16, old.num_rows // 3)))
        for wanted in (1, -1):
            for d, n, keep, sign in zip(*(new.column(c).to_pylist() for c in ("digest", "rows", "keep_id", "sign")), strict=True):
                if sign == wanted == 1:
                    live.insert(d, keep, n)
                elif sign == wanted:
                    live.delete(d, n)
        return _content(key[0].as_py(), live)

    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(change, STATE)


def exact_groups(docs: DataFrame, bucket_rows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lowering A-Z; null counts as empty, and empty texts are equal to each other. Of
    equal texts the row with the largest doc_id stays. Rows that repeat an id and a text are all in the group; they are
    all kept if that id is the largest. Null ids never win against another id; a group of null ids only keeps them all.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keyed = stored(digests(docs), "digests")
    index = build_index(keyed, tasks_for(spark, keyed.count(), bucket_rows))
    found = index.select(F.col("digest").alias("found"), F.col("rows").alias("group_size"), "keep_id")
    return keyed.join(found, F.col("digest") == F.col("found")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents without their exact copies, with all their columns; repeated rows of a kept id leave one row."""
    lowered = F.pandas_udf(lambda t: t.fillna("").map(lambda x: hashlib.sha256(x.encode().lower()).hexdigest()), "string")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")).distinct()
    marked = docs.withColumn("__sha", lowered(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha"))
    return marked.join(kept, same).dropDuplicates(["doc_id", "__sha"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def reference_groups(rows: list[tuple]) -> set[tuple]:
    """The same rows by a plain loop over (doc_id, text), for tests."""
    key = {}
    for doc_id, text in rows:
        key.setdefault(hashlib.sha256((text or "").encode().lower()).hexdigest(), []).append(doc_id)
    out = set()
    for digest, ids in key.items():
        keep = max((i for i in ids if i is not None), default=None)
        out |= {(i, keep, len(ids), i == keep, digest) for i in ids}
    return out

