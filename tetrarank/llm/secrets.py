"""Secret scans by a trigram inverted index: which documents can hold a secret is read from posting lists.

Index: documents are dealt to blocks of bounded rows and bytes; a block has a row per trigram of its lowered bytes with the places of
its documents, as a list or, if many, as bits. It knows nothing of the rules, is kept, and serves rules that are made later.

Scan: a rule's expression gives a Boolean query of trigrams (`trigrams.query_of`). The lists it names are intersected and united
block by block; documents that fulfil it are the rule's candidates. Each text is then searched by the rules it is a candidate
of, and by those without a sure trigram (long hexadecimal runs), for which no list says anything and all texts are read.

Cases: null and empty texts have no spans. Repeated rows are scanned alike. Rows of one doc_id with other texts share their candidate rules,
which costs time only. An empty table gives no rows. Texts are searched whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import drop_stored, new_path, stored
from tetrarank.llm.terms import flat, slices
from tetrarank.llm.trigrams import holds, named, query_of

BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Candidates up to which their table is broadcast (some 20 bytes each).
BROADCAST_CANDIDATES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of a pattern whose `group` has at least `least` characters. ASCII rules: case is that of A-Z."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII

    @property
    def query(self):
        return query_of(self.pattern, self.flags)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run is matched whole or, if shorter, not at all
)

#: The published forms of further credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + MORE

INDEX = "block bigint, trigram int, size int, places binary, ids array<bigint>"


def _number(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _keys(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct trigram * BLOCK_ROWS + row, ascending."""
    lowered = _LOWER[raw].astype(np.int64)
    found = []
    piece = BLOCK_BYTES  # a text of any length goes piece by piece, with two bytes over
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int16)
    for at in range(0, max(len(raw) - 2, 0), piece):
        part = lowered[at:at + piece + 2]
        own = row[at:at + piece + 2]
        same = own[:-2] == own[2:]
        keys = (part[:-2] << 16 | part[1:-1] << 8 | part[2:])[same] * BLOCK_ROWS + own[:-2][same]
        keys.sort()
        found.append(keys[np.append(True, keys[1:] != keys[:-1])[:len(keys)]])
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in slices(batches, 1, BLOCK_BYTES, BLOCK_ROWS):
        yield _rows(block, np.array([-1]), np.array([0]), pa.nulls(1, pa.binary()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())))
        keys = _keys(*flat(batch.column(1)))
        trigram, place = keys // BLOCK_ROWS, keys % BLOCK_ROWS
        first = np.flatnonzero(np.append(True, trigram[1:] != trigram[:-1])[:len(trigram)])
        size = np.diff(np.append(first, len(keys)))
        width = -(-batch.num_rows // 8)
        many = 2 * size > width
        if many.any():
            bits = np.zeros((int(many.sum()), 8 * width), np.uint8)
            bits[np.repeat(np.arange(len(bits)), size[many]), place[np.repeat(many, size)]] = 1
            packed = np.packbits(bits, axis=1)
            yield _rows(block, trigram[first][many], size[many], _binary(packed.reshape(-1), np.full(len(bits), width)))
        if not many.all():
            yield _rows(block, trigram[first][~many], size[~many], _binary(place[np.repeat(~many, size)].astype("<u2").view(np.uint8), 2 * size[~many]))
        block += 1


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(block: int, trigram: np.ndarray, size: np.ndarray, places: pa.Array, ids: pa.Array | None = None) -> pa.RecordBatch:
    n = len(trigram)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), pa.array(trigram.astype(np.int32)), pa.array(size.astype(np.int32)), places,
         pa.nulls(n, pa.list_(pa.int64())) if ids is None else ids], names=["block", "trigram", "size", "places", "ids"])


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Index (doc_id, text) rows at a path, or in the shared folder: rows as in `INDEX`, one per block (trigram -1) with the ids."""
    spark = docs.sparkSession
    path = path or new_path(spark, "trigram-index")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_blocks, INDEX).write.option(
        "compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _candidates(queries: list) -> Callable:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        trigram = rows.column("trigram").to_numpy()
        ids = rows.column("ids")[int(np.flatnonzero(trigram == -1)[0])].values
        at = {int(t): i for i, t in enumerate(trigram)}

        def find(t: bytes) -> np.ndarray:
            mask = np.zeros(len(ids), bool)
            i = at.get(_number(t))
            if i is not None:
                data = np.frombuffer(rows.column("places")[i].as_py(), np.uint8)
                if 2 * rows.column("size")[i].as_py() > -(-len(ids) // 8):
                    mask = np.unpackbits(data)[:len(ids)].astype(bool)
                else:
                    mask[data.view("<u2")] = True
            return mask

        rules = np.zeros(len(ids), np.int64)
        for number, query in queries:
            rules |= holds(query, find).astype(np.int64) << number
        hit = np.flatnonzero(rules)
        yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(hit)), "rules": pa.array(rules[hit])})

    return run


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, rules (bits): documents that fulfil the trigram query of a rule, read from the index alone. At most 63 rules."""
    if len(rules) > 63:
        raise ValueError("more than 63 rules: scan in parts")
    queries = [(i, q) for i, rule in enumerate(rules) if (q := rule.query) is not None]
    asked = sorted({_number(t) for _, q in queries for t in named(q)})
    return (index.where(F.col("trigram").isin([-1, *asked])).groupBy("block").applyInArrow(_candidates(queries), "doc_id bigint, rules bigint")
            .groupBy("doc_id").agg(F.bit_or("rules").alias("rules")))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _verify(rules: tuple[Rule, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        sure = sum(1 << i for i, r in enumerate(rules) if r.query is None)
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in slices(batches, 1, BLOCK_BYTES, BLOCK_ROWS):
            out = []
            for text, mask in zip(batch.column(1).to_pylist(), pc.fill_null(batch.column(2), 0).to_pylist(), strict=True):
                spans = []
                for i, rule in enumerate(rules):
                    if (mask | sure) >> i & 1 and text:
                        spans += [(m.start(), i, m.end()) for m in compiled[i].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                out.append([{"kind": rules[i].name, "start": a, "end": b} for a, i, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kinds))], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end in code points; by start, then rule) per row of docs.

    `index` must hold all rows of docs; without one it is built, and deleted after use.
    """
    own = build_index(docs) if index is None else index
    hits = stored(candidates(own, rules), "secret-candidates")
    if index is None:
        drop_stored(docs.sparkSession, own)
    small = F.broadcast(hits) if hits.count() <= BROADCAST_CANDIDATES else hits
    ids = F.col("doc_id").cast("bigint")
    texts = docs.select(ids.alias("doc_id"), "text").join(small.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return texts.select("doc_id", "text", "rules").mapInArrow(_verify(rules), f"doc_id bigint, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) of scanned rows."""
    base = [r.name for r in BASE]

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def _found(rule: Rule, order: int) -> str:
    """SQL for the spans of a rule: the lengths of matches and of what lies between them, added up."""
    pattern = rule.pattern.replace("'", "''")
    if rule.flags & re.IGNORECASE:  # words letter by letter, since (?i) of DuckDB also folds letters beyond ASCII
        pattern = re.sub("[a-z]{3,}", lambda m: "".join(f"[{c}{c.upper()}]" for c in m.group()), pattern)
    return f"""SELECT row, {order} AS kind_order, '{rule.name}' AS kind, list_extract(starts, i) AS start, list_extract(starts, i) + length(list_extract(hits, i)) AS stop,
                      length(list_extract(kept, i)) >= {rule.least} AS good
               FROM (SELECT row, hits, kept, unnest(range(1, len(hits) + 1)) AS i,
                            [coalesce(list_sum([length(g) FOR g IN gaps[1:i]]), 0) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0)
                             FOR i IN range(1, len(hits) + 1)] AS starts
                     FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS kept,
                                  string_split_regex(text, '{pattern}') AS gaps FROM docs WHERE regexp_matches(text, '{pattern}')))"""


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of `digest(scan(documents, rules))`."""
    base = ", ".join(f"'{r.name}'" for r in BASE)
    listed = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_order)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE)
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({" UNION ALL ".join(_found(r, i) for i, r in enumerate(rules))}),
    listed AS (SELECT row, {counts}, {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans FROM found WHERE good GROUP BY row)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0)::BIGINT AS n_{r.name}" for r in BASE)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN listed USING (row)"""
