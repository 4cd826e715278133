"""Source divergence audit: how far the term shares of the sources of a language lie from each other.

A language keeps the terms found in enough of its documents. A group (language, source), and the language, gives each kept
term the smoothed share p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Two sources differ by the sum of |p - q| over all kept terms.

The sum is a sparse matrix product in Gustavson's order. Kept terms are dealt to shards. A shard holds its terms' lists of
(source, p), the term-major index. Row by row, each source scatters its terms through that index into one dense accumulator
with an entry per peer; no (source, source, term) triple leaves the task. Terms that a source lacks have its share at count 0, its
baseline z. The accumulator takes what a shared term adds to the sum that would hold if no term were shared,

    |p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|,

and that sum itself comes from sorted shares and their running totals, a look-up per peer.

Cases: null text, language and source count as ''. Empty texts have no terms, their groups count all the same (all shares are
the baseline). Repeated rows are documents of their own. Ties are ranked by item. A language without kept terms has value 0 for
each pair and no `term` rows; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tetrarank.llm.common import stored
from tetrarank.llm.terms import LETTERS, arrays, counted, slices, terms

#: Groups up to which their table is broadcast (some 100 bytes each).
BROADCAST_GROUPS = 200_000
#: Bytes of text whose counts are made together in a task.
SLICE = 4 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), counted over a slice of the rows."""
    for batch in slices(batches, 2, SLICE, 1 << 20):
        words, row = terms(batch.column(2), LETTERS)
        if not len(words):
            continue
        coded = words.dictionary_encode()
        width = len(coded.dictionary)
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        pairs, n = counted(row * width + coded.indices.to_numpy())
        key = group[pairs // width] * width + pairs % width
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        key = key[order][first]
        where = key // width
        yield arrays(len(first), lang=lang.dictionary.take(pa.array(where // len(source.dictionary))),
                     source=source.dictionary.take(pa.array(where % len(source.dictionary))),
                     term=coded.dictionary.take(pa.array(key % width)).cast(pa.binary()), n=np.add.reduceat(n[order], first).astype(np.int64),
                     docs=np.diff(np.append(first, len(order))).astype(np.int64))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    return (found.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in whole numbers of any size."""
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(19,0)")
    return F.call_function("div", above, (total + 5 * kept).cast("decimal(20,0)")) + 1


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n of kept terms, with the language's count `total`, the sources that hold it, and `lead` in one of its rows."""
    term = W.partitionBy("lang", "term")
    rows = term_counts(docs).select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("total"),
        F.count(F.lit(1)).over(term).alias("holders"), (F.col("source") == F.min("source").over(term)).cast("bigint").alias("lead"))
    return rows.where(F.col("df") >= least).drop("df")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per occurring (lang, source): N, z, and of its language: V, N (`lang_n`), groups, shards."""
    sums = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"), F.sum("lead").alias("v"), F.sum(F.col("total") * F.col("lead")).alias("lang_n"),
        F.sum("holders").alias("work"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    lang = W.partitionBy("lang")
    out = groups.join(sums, ["lang", "source"], "left").na.fill(0).select(
        "lang", "source", "n", *[F.sum(c).over(lang).alias(c) for c in ("v", "lang_n", "held", "work")], F.count(F.lit(1)).over(lang).alias("groups"))
    # A shard has some 20,000 entries, more if its accumulators would outnumber them, never over a million or 2e9 products.
    entries = F.greatest(F.lit(20_000), F.least(4 * F.col("groups") * F.col("groups"), F.lit(1_000_000)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("held") / entries), F.ceil(F.col("work") / 2e9)).cast("int")
    return out.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n", shards.alias("shards"),
                      F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0).alias("z"))


def row_sums(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each z the sum of |p - z| over all p, from the sorted shares and their running totals."""
    p = np.sort(p)
    upto = np.append(0, np.cumsum(p))
    below = np.searchsorted(p, z)
    return z * below - upto[below] + (upto[-1] - upto[below]) - z * (len(p) - below)


def scatter(group: np.ndarray, term: np.ndarray, p: np.ndarray, z: np.ndarray, terms_: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(g, peers, parts): what row g adds to the sum of the pair (g, peer), over the terms of a shard.

    The parts of (g, h) and of (h, g) together are the sum of |p_g - p_h|.
    """
    order = np.lexsort((group, term))  # the term-major index
    t_group, t_p, head = group[order], p[order], np.searchsorted(term[order], np.arange(terms_ + 1))
    rows = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[rows], np.arange(len(z) + 1))
    held = np.diff(ends)
    for g in range(len(z)):
        mine = rows[ends[g]:ends[g + 1]]
        acc = np.zeros(len(z), np.int64)
        at = 0
        while at < len(mine):  # a bounded number of index entries at a time
            sizes = head[term[mine[at:]] + 1] - head[term[mine[at:]]]
            some = max(1, int(np.searchsorted(np.cumsum(sizes), 4_000_000, side="right")))
            now, sizes = mine[at:at + some], sizes[:some]
            entry = np.repeat(head[term[now]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            peer, theirs, own = t_group[entry], t_p[entry], np.repeat(p[now], sizes)
            later = peer > g
            peer, theirs, own = peer[later], theirs[later], own[later]
            gain = np.abs(own - theirs) - np.abs(own - z[peer]) - np.abs(z[g] - theirs) + np.abs(z[g] - z[peer])
            acc += np.bincount(peer, weights=gain, minlength=len(z)).astype(np.int64)  # whole numbers under 2^53, so exact
            at += some
        later = np.arange(len(z)) > g
        acc += np.where(later, (terms_ - held[g] - held) * np.abs(z[g] - z), 0) + row_sums(p[mine], z)
        peers = np.flatnonzero(np.arange(len(z)) != g)
        yield g, peers, acc[peers]


def _cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, term, p, z) of a shard, and one row without term per source of the language, to (lang, one, other, value)."""
    rows = pa.Table.from_batches(batches)
    peers = rows.filter(pc.is_null(rows.column("term"))).sort_by("source")
    rows = rows.filter(pc.is_valid(rows.column("term")))
    names = peers.column("source").combine_chunks()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    group = pc.index_in(rows.column("source"), names).to_numpy().astype(np.int64)
    parts = scatter(group, coded.indices.to_numpy().astype(np.int64), rows.column("p").to_numpy(), peers.column("z").to_numpy(), len(coded.dictionary))
    for g, peer, value in parts:
        if len(peer):
            yield arrays(len(peer), lang=pa.array([key[0].as_py()] * len(peer), pa.string()), one=names.take(pa.array(np.minimum(g, peer))),
                         other=names.take(pa.array(np.maximum(g, peer))), value=value)


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows of all peers, `term` rows of the `top` terms that a source overuses most."""
    kept = stored(kept_terms(docs, least), "divergence-terms")
    groups = stored(group_table(docs, kept), "divergence-groups")
    small = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    shares = kept.join(small, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), "z", "shards",
        share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    own = W.partitionBy("lang", "source")

    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    entries = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "p", "z")
    peers = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source",
                          F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("p"), "z")
    parts = entries.unionByName(peers).groupBy("lang", "shard").applyInArrow(_cell, "lang string, one string, other string, value bigint")
    sums = parts.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item")))
    return pairs.unionByName(over)


ORACLE = r"""
    WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
    shares AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // (coalesce(n, 0) + 5 * v) AS p
               FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)),
    lang_n AS (SELECT lang, sum(c) AS n FROM counts GROUP BY lang),
    lang_p AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)::HUGEINT) // (any_value(n) + 5 * any_value(v)) AS q
               FROM counts JOIN sizes USING (lang) JOIN lang_n USING (lang) GROUP BY lang, term),
    peers AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM peers LEFT JOIN sums USING (lang, source, item)
              UNION ALL
              SELECT lang, source, 'term', term, p - q FROM shares JOIN lang_p USING (lang, term) WHERE c > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
