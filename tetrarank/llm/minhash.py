"""Near duplicates: many universal hash minima, banding, signature and set verification, connected components.

1. Every whole text becomes its set of word shingles (64-bit hashes), 128 minima of universal hashes a x + b modulo 2^64, and
   32 bands of four minima. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^4)^32 < 1e-7.
2. Texts with equal sets are one node, so copies never meet again. Each band value links its nodes to the smallest of
   them; the components of these links are families: all pairs that share a band are inside one.
3. The texts of families with more than one node come together. A family with many rows or shingles is split into blocks of
   bounded size, and a few pivots go to every block, so blocks hang together through them. Inside a block nodes are visited
   from link to link: a visited node is compared with the nodes not yet reached, by size, signature, and then whole set.
   Only the links followed leave the task.
4. In a split family, nodes outside its largest component so far then visit the other blocks, but only those that share one of
   their rarest shingles: of two sets as similar as a link asks, the rarest (1 - similarity) of each, in any one order of
   all shingles, have one in common, so no link between blocks is lost. Ids and hashes alone decide this; then the texts
   move, and the guests of a block are dealt to cells of bounded size.
5. The components of the links found are the groups.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetrarank.llm.common import small_batches, stored, text_bytes
from tetrarank.llm.components import components

PERMUTATIONS, ROWS = 128, 4
BANDS = PERMUTATIONS // ROWS
#: The share of equal minima lies this far below the similarity with a probability under 1e-7 (five deviations and more).
SLACK = 0.2
BLOCK_NODES, BLOCK_SHINGLES, PIVOTS = 1000, 2_000_000, 8
#: Counters of shingles by hash, which order them by how rare they are.
COUNTERS = 1 << 18

_random = np.random.default_rng(20240229)
A = (_random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
STEPS = (_random.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_sets(data: list[bytes], width: int, known: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lowered, words parted by ASCII white space."""
    words = [t.lower().split() for t in data]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    if len(flat) >= width:
        n = len(flat) - width + 1
        hashed = flat[:n] * STEPS[0]
        for k in range(1, width):
            hashed = _mix(hashed) + flat[k:k + n] * STEPS[k]
        hashed = _mix(hashed)
    out = []
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if size >= width:
            out.append(np.unique(hashed[end - size:end - width + 1]))
        elif size:
            short = b" ".join(flat[end - size:end].tobytes()[8 * i:8 * i + 8] for i in range(size))
            out.append(np.array([int.from_bytes(hashlib.blake2b(short, digest_size=8, person=b"short").digest(), "little")], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (one row per set that is not empty): the minimum of each universal hash over the set."""
    full = [s for s in sets if len(s)]
    out = np.empty((len(full), PERMUTATIONS), np.uint64)
    at = 0
    while at < len(full):
        upto, total = at, 0
        while upto < len(full) and (upto == at or total + len(full[upto]) <= 32_768):
            total += len(full[upto])
            upto += 1
        flat = np.concatenate(full[at:upto])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in full[at:upto - 1]], dtype=np.int64)]).astype(np.int64)
        room = np.empty_like(flat)
        for j in range(PERMUTATIONS):
            np.multiply(flat, A[j], out=room)
            np.add(room, B[j], out=room)
            out[at:upto, j] = np.minimum.reduceat(room, starts)
        at = upto
    return out


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])


def sketches(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets, null without words), bands, signature (16 bits of each minimum)."""

    def run(batches):
        known = Words()
        for batch in small_batches(batches, 300):
            sets = shingle_sets(text_bytes(batch.column(1)), width, known)
            low = minima(sets)
            rows = _mix(low.reshape(-1, BANDS, ROWS) * STEPS[:ROWS]).sum(axis=2, dtype=np.uint64)
            bands = _mix(rows + np.arange(BANDS, dtype=np.uint64) * STEPS[9]).view(np.int64)
            marks = (low >> np.uint64(48)).astype(np.uint16)
            keys, values, signs, at = [], [], [], 0
            for s in sets:
                full = len(s) > 0
                keys.append(set_key(s) if full else None)
                values.append(bands[at] if full else None)
                signs.append(marks[at].tobytes() if full else None)
                at += full
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(values, pa.list_(pa.int64())), pa.array(signs, pa.binary())], schema=SKETCH)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary")


class Block:
    """Nodes whose sets are at hand."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], signatures: list[bytes]):
        self.nodes, self.sets = nodes, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.marks = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(nodes), PERMUTATIONS)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of `others` whose similarity with node i is `percent` or more: by size, by signature, by whole set."""
        size = self.sizes[i]
        others = others[(100 * np.minimum(self.sizes[others], size) >= percent * np.maximum(self.sizes[others], size))]
        if len(others):
            others = others[(self.marks[others] == self.marks[i]).mean(axis=1) >= percent / 100 - SLACK]
        if not len(others):
            return others
        flat = np.concatenate([self.sets[o] for o in others])
        place = np.minimum(np.searchsorted(self.sets[i], flat), size - 1)
        common = np.add.reduceat((self.sets[i][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(self.sizes[others][:-1])]))
        return others[100 * common >= percent * (self.sizes[others] + size - common)]

    def visit(self, percent: int) -> tuple[list[tuple[int, int]], list[int]]:
        """Links that join all that is linked inside the block, and the first node visited of each node's part."""
        left, found, part = np.arange(len(self.nodes)), [], np.zeros(len(self.nodes), np.int64)
        while len(left):
            start, left = int(left[0]), left[1:]
            part[start], queue = start, [start]
            while queue and len(left):
                i = queue.pop()
                near = self.linked(i, left, percent)
                if len(near):
                    found += [(self.nodes[i], self.nodes[o]) for o in near.tolist()]
                    part[near] = start
                    left = np.setdiff1d(left, near, assume_unique=True)
                    queue += near.tolist()
        return found, [self.nodes[p] for p in part.tolist()]

    def meet(self, guests: list[int], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """One link at most of each guest to every other component of those at home in the block."""
        found = []
        home = np.ones(len(self.nodes), bool)
        home[guests] = False
        for g in guests:
            others = np.flatnonzero(home & (roots != roots[g]))
            near = self.linked(g, others, percent)
            if len(near):
                first = np.unique(roots[near], return_index=True)[1]
                found += [(self.nodes[g], self.nodes[int(o)]) for o in near[first]]
        return found


FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("family", pa.int64()), ("block", pa.int32())])


def _blocks(width: int, percent: int, guests: bool):
    """mapInArrow over rows (family, block, node, signature, pivot, part, k, text) sorted by family, block and pivots first.

    Gives the links found (family and block null) and, before guests come, the part that each node of a split family is in:
    visited from the pivots on, nodes that hang together with one get the first such pivot.
    """

    def work(rows: list[tuple], known: Words) -> list[tuple]:
        sets = shingle_sets([r[7] for r in rows], width, known)
        own = [i for i, s in enumerate(sets) if set_key(s) == rows[i][6]]  # an id may have other texts, too
        rows, sets = [rows[i] for i in own], [sets[i] for i in own]
        block = Block([r[2] for r in rows], sets, [r[3] for r in rows])
        if guests:
            links = block.meet([i for i, r in enumerate(rows) if r[4]], np.array([r[5] for r in rows], np.int64), percent)
            return [(u, v, None, None) for u, v in links]
        links, parts = block.visit(percent)
        out = [(u, v, None, None) for u, v in links]
        if any(r[4] for r in rows):
            out += [(r[2], p, r[0], r[1]) for r, p in zip(rows, parts, strict=True) if not r[4] or r[5] == r[1]]
        return out

    def run(batches):
        known, held, key, found = Words(), [], None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

        for batch in small_batches(batches, 500):
            columns = [batch.column(i).to_pylist() for i in range(7)] + [text_bytes(batch.column(7))]
            for row in zip(*columns, strict=True):
                if row[:2] != key:
                    if len(held) > 1:
                        found += work(held, known)
                    held, key = [], row[:2]
                held.append(row)
            if found:
                yield batch_of(found)
                found = []
        if len(held) > 1:
            found = work(held, known)
            if found:
                yield batch_of(found)

    return run


def _compared(rows: DataFrame, width: int, percent: int, guests: bool, label: str) -> DataFrame:
    spread = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("family", "block", "node", "signature", "mark", "part", "k", "text").repartition(spread, "family", "block")
    ordered = dealt.sortWithinPartitions("family", "block", F.desc("mark"), "node")
    return stored(ordered.mapInArrow(_blocks(width, percent, guests), "u bigint, v bigint, family bigint, block int"), label)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (is it this one).

    Two documents are linked when 100 * common >= percent * union of their shingle sets. A text with fewer words than
    `width` has its whole word sequence as its one shingle; a text without words or null has none and is linked with nothing.
    Rows that share an id count as one document with the links of each. A null doc_id has no place among links: its
    component_id is null and it is kept. An empty table gives an empty result.
    """
    known = stored(sketches(docs, width), "sketches")
    named = known.where("doc_id is not null and set_key is not null")
    nodes = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "nodes")
    chosen = named.select(F.col("set_key").alias("k"), "doc_id", "n_shingles", "bands", "signature").join(
        nodes, (F.col("set_key") == F.col("k")) & (F.col("node") == F.col("doc_id"))).select(
        "node", "k", "n_shingles", "bands", "signature").dropDuplicates(["node", "k"])
    chosen = stored(chosen, "chosen")
    banded = chosen.select("node", F.explode("bands").alias("band")).where("band is not null")
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select(
        F.col("band").alias("b"), "head")
    family = stored(components(banded.join(heads, F.col("band") == F.col("b")).select("node", "head"), "node", "head"), "families").select(
        F.col("node").alias("f_node"), F.col("root").alias("family"))
    members = chosen.select("node", "n_shingles", "signature", "k").join(family, F.col("node") == F.col("f_node")).drop("f_node")
    sizes = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").cast("string").alias("text"))
    placed = members.join(sizes.withColumnRenamed("family", "f"), F.col("family") == F.col("f")).drop("f")
    # Repeated rows leave one; an id with several texts keeps each of them.
    full = texts.join(placed, F.col("t_id") == F.col("node")).withColumn("h", F.xxhash64("text")).dropDuplicates(["node", "k", "h"])
    full = stored(full.drop("t_id", "h"), "family-texts")
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    order = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node", "k")
    pivots = stored(full.where("blocks > 1").select("family", "node", "k").withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS).select(
        F.col("node").alias("p_node"), F.col("k").alias("p_k")), "pivots")
    rows = full.join(pivots, (F.col("node") == F.col("p_node")) & (F.col("k") == F.col("p_k")), "left").withColumns(
        {"mark": F.col("p_node").isNotNull(), "part": home.cast("long")})
    everywhere = F.when(F.col("mark"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    found = _compared(rows.withColumn("block", F.explode(everywhere)), width, percent, False, "links-inside")
    links = found.where("family is null").select("u", "v")
    if full.where("blocks > 1").limit(1).count():
        links = links.unionByName(_across(full, found.where("family is not null"), width, percent).select("u", "v"))
    grouped = components(links)
    found = nodes.join(grouped.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node"), "left").select(
        F.col("set_key").alias("k"), F.coalesce("root", "node").alias("component"))
    labelled = known.select("doc_id", "n_shingles", "set_key").join(found, F.col("set_key") == F.col("k"), "left")
    out = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return labelled.select("doc_id", "n_shingles", out.alias("component_id"),
                           (F.col("doc_id").isNull() | (F.col("doc_id") == out)).alias("kept"))


def _own_sets(batches, width: int):
    """Per small batch of rows (node, k, text): the nodes whose text has the set k, and their sets."""
    known = Words()
    for batch in small_batches(batches, 500):
        sets = shingle_sets(text_bytes(batch.column(2)), width, known)
        own = [i for i, key in enumerate(batch.column(1).to_pylist()) if set_key(sets[i]) == key]
        nodes = batch.column(0).to_pylist()
        yield [nodes[i] for i in own], [sets[i] for i in own]


def _counters(rows: DataFrame, width: int) -> np.ndarray:
    """Sets of `rows` (node, k, text) per hash of a shingle."""
    schema = pa.schema([("counter", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, sets in _own_sets(batches, width):
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=schema)

    counted = rows.mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    return out


def rarest(shingles: np.ndarray, counters: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles by counter and hash: sets linked at `percent` share one of them. Those nobody else has are left out."""
    n = counters[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    first = np.argsort(n, kind="stable")[:len(n) + (-percent * len(n) // 100) + 1]
    return shingles[first[n[first] > 1]]


def _rare(rows: DataFrame, counters: np.ndarray, width: int, percent: int) -> DataFrame:
    """node, shingle: the rarest shingles of the sets of `rows` (node, k, text)."""
    schema = pa.schema([("node", pa.int64()), ("shingle", pa.int64())])
    shared = rows.sparkSession.sparkContext.broadcast(counters)  # COUNTERS numbers

    def run(batches):
        for nodes, sets in _own_sets(batches, width):
            found = [rarest(s, shared.value, percent) for s in sets]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), [len(f) for f in found])),
                                                  pa.array(np.concatenate(found).view(np.int64))], schema=schema)

    return rows.mapInArrow(run, "node bigint, shingle bigint")


def _visits(rows: DataFrame, sides: DataFrame, width: int, percent: int) -> DataFrame:
    """Blocks (v_family, v_node, v_block) in which nodes of `sides` that are outside may have links, from the texts in `rows`.

    Of two nodes outside, the one in the lower block visits the other's.
    """
    rare = stored(_rare(rows, _counters(rows, width), width, percent), "rare")
    common = rare.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(F.col("shingle").alias("s"))
    places = sides.select(F.col("node").alias("n"), "family", "s_block", "part", "outside")
    met = stored(rare.join(common, F.col("shingle") == F.col("s")).join(places, F.col("node") == F.col("n")).select(
        "family", "shingle", "node", "s_block", "part", "outside"), "rare-shared")
    there = met.groupBy(F.col("family").alias("v_family"), F.col("shingle").alias("v_shingle"), F.col("s_block").alias("v_block")).agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.max(~F.col("outside")).alias("main"))
    return met.where("outside").join(there, (F.col("family") == F.col("v_family")) & (F.col("shingle") == F.col("v_shingle"))).where(
        "(v_block > s_block or (v_block < s_block and main)) and (low != part or high != part)").select(
        "v_family", F.col("node").alias("v_node"), "v_block").distinct()


def _across(full: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of nodes outside the largest part of their split family, sought in the other blocks that may have one.

    Parts may hang together through other blocks; that costs comparisons, but loses no link. Inside a block all links are
    known. A cell is a block with some BLOCK_NODES or BLOCK_SHINGLES of its guests.
    """
    named = stored(parts.select(F.col("u").alias("s_node"), F.col("v").alias("part"), F.col("family").alias("s_family"), F.col("block").alias("s_block")).distinct(), "parts")
    counted = named.groupBy("s_family", "part").agg(F.count(F.lit(1)).alias("n"))
    main = stored(counted.groupBy("s_family").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where(
        "parts > 1").select(F.col("s_family").alias("f"), "main"), "main")
    split = full.where("blocks > 1")
    sides = split.groupBy("node", "family", "blocks").agg(F.max("n_shingles").alias("n_shingles")).join(
        named, (F.col("node") == F.col("s_node")) & (F.col("family") == F.col("s_family"))).join(main, F.col("family") == F.col("f")).select(
        "node", "family", "blocks", "n_shingles", "s_block", "part", (F.col("part") != F.col("main")).alias("outside"))
    sides = stored(sides, "sides")
    rows = split.join(main, F.col("family") == F.col("f"), "left_semi").select("node", "k", "text")
    visits = stored(_visits(rows, sides, width, percent), "visits")
    guests = sides.where("outside").join(visits, (F.col("family") == F.col("v_family")) & (F.col("node") == F.col("v_node")))
    cells = stored(guests.groupBy(F.col("v_family").alias("c_family"), F.col("v_block").alias("c_block")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("cells")), "cells")
    # Each node lies in all cells of its block, a guest in one cell of each block it visits.
    at_home = sides.join(cells, (F.col("family") == F.col("c_family")) & (F.col("s_block") == F.col("c_block"))).withColumns(
        {"cell": F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)), "mark": F.lit(False)})
    visiting = guests.join(cells, (F.col("family") == F.col("c_family")) & (F.col("v_block") == F.col("c_block"))).withColumns(
        {"cell": F.pmod(F.xxhash64("node", "c_block"), F.col("cells")), "mark": F.lit(True)})
    columns = [F.col("node").alias("e_node"), F.col("family").alias("e_family"), "part", "mark", (F.col("cell") * F.col("blocks") + F.col("c_block")).alias("block")]
    entries = stored(at_home.select(*columns).unionByName(visiting.select(*columns)), "entries")
    return _compared(split.join(entries, (F.col("node") == F.col("e_node")) & (F.col("family") == F.col("e_family"))), width, percent, True, "links-across")


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates, with all their columns: of a group that with the smallest doc_id stays."""
    kept = near_groups(docs, width, percent).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def reference_groups(rows: list[tuple], width: int = 5, percent: int = 80) -> set[tuple]:
    """The same rows from all pairs of (doc_id, text), for tests."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    by_word: dict = {}
    for i in ids:
        for s in sets[i]:
            by_word.setdefault(s, []).append(i)
    counts: dict = {}
    for group in by_word.values():
        for k, b in enumerate(group):
            for a in group[:k]:
                counts[a, b] = counts.get((a, b), 0) + 1
    for (a, b), common in counts.items():
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}
