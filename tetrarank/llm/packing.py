"""Packing documents into token sequences by the sum-of-squares rule.

Documents are tokenized where they are read; only lengths and checksums travel. A document longer than a sequence is cut
into whole sequences, its first piece taking the remainder. Pieces are dealt at random to groups of bounded size, and a
group places its pieces one by one, longest first: among the open sequences with room (one per residual gap needs looking
at) the one is taken that makes the sum over gaps of the squared number of open sequences smallest; a new sequence is
opened when none has room. A group leaves at most a few sequences part empty, against some ten thousand full ones.

Word ids come from the given tokenizer. Words repeat, so a task remembers the ids of the words it has met (a bounded
number of them); text is cut before a blank that a letter or digit follows, where no token crosses.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import small_batches, stored, texts

GAP = re.compile(r" (?:\s|$)")
CUT = re.compile(r" (?=\S)")
assert sys.byteorder == "little" and array("I").itemsize == 4
END = b"\0\0\0\0"
PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer by bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(byte_of[c] for c in word): i for word, i in tokenizer.get_vocab().items() if word not in special}


class WordIds(dict):
    """Ids of a word that a blank precedes, as little-endian unsigned 32-bit integers, remembered up to a bound.

    A word of letters is one unit of the tokenizer, so its merges can be run on it alone; a closing punctuation mark is
    another unit. Everything else goes to the tokenizer as it is.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        ranks = _byte_ranks(self.tokenizer)
        self.merge = tiktoken.Encoding("words", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.marks = {m: array("I", [ranks[m.encode()]]).tobytes() for m in ".,;:!?"}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word.isalpha():
            ids = array("I", self.merge((" " + word).encode())).tobytes()
        elif word[-1:] in self.marks and word[:-1].isalpha():
            ids = self[word[:-1]] + self.marks[word[-1]]
        else:
            ids = self.of(" " + word)
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def token_bytes(text: str, known: WordIds) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers, with the closing id 0.

    The text is cut before each blank that no white space follows; no token crosses such a place.
    """
    if not text:
        return END
    first, *rest = CUT.split(text) if GAP.search(text) else text.split(" ")
    return b"".join([known.of(first), *map(known.__getitem__, rest), END])


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row per piece of a document: doc_id, row (number of the input row), piece, start, length, ids_crc32.

    Null text counts as empty: one piece that holds only the closing id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        known = word_ids(tokenizer)
        for batch in small_batches(batches, 200):
            out = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                ids = token_bytes(text, known)
                view = memoryview(ids)
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    out.append((doc_id, row, k, start, length, zlib.crc32(view[4 * start:4 * (start + length)])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order by the sum-of-squares rule.

    Putting a piece of length s into a sequence with gap g changes the sum of squares by 2 (N[g - s] - N[g]) + 2 for
    g > s and by 1 - 2 N[g] when it fills the sequence, N counting the open sequences of a gap. Ties go to the smaller gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gaps = counts[s:]
        change = np.where(gaps > 0, 2 * (counts[:capacity + 1 - s] - gaps) + 2, np.iinfo(np.int64).max)
        if gaps[0]:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin())
        if gaps[best]:
            gap = s + best
            number = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, made
            made += 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > s:
            open_at[gap - s].append(number)
            counts[gap - s] += 1
    return sequence, offset


PACKED = PIECES + ", sequence_id bigint, offset bigint"


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 50_000, groups: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset. Whole pieces fill a sequence of their own."""
    total = pieces.count()
    groups = groups or max(1, -(-total // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int"))

    def run(key, rows):
        rows = rows.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        sequence, offset = place(rows.column("length").to_numpy(), capacity)
        return rows.drop_columns("group").append_column("sequence_id", pa.array(sequence * groups + key[0].as_py())).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Where every piece of every document goes: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are documents of their own, told apart by `row`. Null ids are kept. An empty table gives an empty result.
    """
    return pack(stored(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str) -> DataFrame:
    """The token sequences themselves: sequence_id and its ids in order. Documents are matched by doc_id."""

    def run(batches):
        known = word_ids(tokenizer)
        schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in small_batches(batches, 200):
            rows = []
            for text, start, length, sequence, offset in zip(texts(batch.column(0)), *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                rows.append((sequence, offset, np.frombuffer(token_bytes(text, known), "<u4")[start:start + length].astype(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    joined = packed.join(docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text")), F.col("doc_id").eqNullSafe(F.col("__doc")))
    parts = joined.select("__text", "start", "length", "sequence_id", "offset").mapInArrow(run, "sequence_id bigint, offset bigint, ids array<bigint>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most `capacity` pieces
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
