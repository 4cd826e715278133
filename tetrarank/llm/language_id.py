"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of it. A text is parsed by it from left to
right into phrases, each the longest match from where the last one ended. The fewer phrases, the closer the language: the
estimate of the cross entropy is phrases * log2(n) / length, n being the length of the labelled text, and the smallest
estimate wins.

The edges of all automata lie in one open-addressed table with 64-bit keys of state and symbol, so its size follows the
labelled text and not the alphabet: an automaton of n characters has at most 3n edges, and the table at most eight places
of 12 bytes for each. A lookup per character and language parses many texts at once, column by column; where no match
goes on, a new phrase begins with the edge of the root. Long texts are parsed in segments of 2,000 characters, whose phrases are summed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrarank.llm.common import drop_stored, stored
from tetrarank.llm.toxicity import first_by_hash, remainder

SEGMENT = 2000
WINDOW = 75  # characters that a sampled text gives in one place, at least
OTHER = 0  # the symbol of characters that no labelled text has
HASH = np.uint64(0x9E3779B97F4A7C15)


class _Cleaner(dict):
    """For str.translate: keeps letters, turns everything else into blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = c if c.isalpha() else " "
        return value


def cleaned(text: str, cleaner: _Cleaner) -> str:
    """Lower case; runs of anything but letters become one blank, also before and after the text."""
    return " " + " ".join(text.lower().translate(cleaner).split()) + " "


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Edges (symbol to state) of each state of the suffix automaton of a sequence; state 0 is its root."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return follow


class Edges:
    """Map from 64-bit keys to states (int32): open addressing with at most a quarter of the places taken."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):  # of the keys at a free place the first one takes it, the others go on to the next
            free = np.flatnonzero(self.keys[at] == -1)
            taken, first = np.unique(at[free], return_index=True)
            self.keys[taken], self.targets[taken] = keys[left[free[first]]], targets[left[free[first]]]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * HASH) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The state of each key, or -1."""
        at = self._place(keys)
        seen, out = self.keys[at], self.targets[at]
        left = np.flatnonzero(seen != keys)
        out[left] = -1
        left = left[seen[left] != -1]
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.keys[at[left]]
            own = seen == keys[left]
            out[left[own]] = self.targets[at[left[own]]]
            left = left[~own & (seen != -1)]
        return out


class Languages:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in samples.values() for c in t}))}
        self.size = len(self.alphabet) + 1
        self.bits = np.array([np.log2(max(2, len(samples[n]))) for n in self.names])
        self.roots = np.zeros(len(self.names), np.int64)
        self.begin = np.zeros((len(self.names), self.size), np.int32)  # the state of a phrase that begins with a symbol
        keys, targets, states = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for i, name in enumerate(self.names):
            follow = automaton([self.alphabet[c] for c in samples[name]])
            self.roots[i] = states
            degree = [len(edges) for edges in follow]
            own = np.repeat(np.arange(states, states + len(follow), dtype=np.int64), degree)
            keys.append(own * self.size + np.fromiter((c for edges in follow for c in edges), np.int64, sum(degree)))
            targets.append(np.fromiter((t + states for edges in follow for t in edges.values()), np.int64, sum(degree)))
            self.begin[i] = states
            self.begin[i, list(follow[0])] = [t + states for t in follow[0].values()]
            states += len(follow)
        if states >= 1 << 31:
            raise ValueError("too much labelled text: automata of all languages together have 2^31 states or more")
        self.edges = Edges(np.concatenate(keys), np.concatenate(targets).astype(np.int32))
        codes = np.array([ord(c) for c in self.alphabet], np.int64)
        self.codes, self.symbols = codes, np.array(list(self.alphabet.values()), np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.symbols[at], OTHER)

    def phrases(self, batch: list[str]) -> np.ndarray:
        """Number of phrases (texts, languages) of normalised texts."""
        pieces, owner = [], []
        for i, text in enumerate(batch):
            symbols = self._symbols(text)
            for at in range(0, len(symbols), SEGMENT):
                pieces.append(symbols[at:at + SEGMENT])
                owner.append(i)
        out = np.zeros((len(batch), len(self.names)), np.int64)
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        for first in range(0, len(order), 4096):
            lanes = order[first:first + 4096]
            sizes = np.array([len(pieces[k]) for k in lanes])
            grid = np.zeros((int(sizes[0]), len(lanes)), np.int32)
            for lane, k in enumerate(lanes):
                grid[:sizes[lane], lane] = pieces[k]
            alive = np.searchsorted(-sizes, -np.arange(1, len(grid) + 1), side="right")  # lanes that have a character at each step
            counts = np.ones((len(self.names), len(lanes)), np.int32)  # the first phrase
            state = np.repeat(self.roots[:, None], len(lanes), axis=1)
            for step, n in enumerate(alive.tolist()):
                found = self.edges.find((state[:, :n] * self.size + grid[step, :n]).ravel()).reshape(-1, n)
                ended = found < 0
                counts[:, :n] += ended
                state[:, :n] = np.where(ended, self.begin[:, grid[step, :n]], found)
            np.add.at(out, np.array(owner)[lanes], counts.T)
        return out

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of raw texts: `und` and 0 without letters or without languages."""
        cleaner = _CLEANER
        ready = [cleaned(t, cleaner) for t in batch]
        lengths = np.array([len(t) for t in ready])
        worth = (lengths > 2) if self.names else np.zeros(len(batch), bool)
        names, scores = ["und"] * len(batch), np.zeros(len(batch))
        own = np.flatnonzero(worth)
        if len(own):
            rate = self.phrases([ready[i] for i in own]) * self.bits / lengths[own][:, None]
            best = rate.argmin(axis=1)
            ranked = np.sort(rate, axis=1)
            lead = ranked[:, 1] if rate.shape[1] > 1 else ranked[:, 0] * 2
            for i, b in zip(own, best, strict=True):
                names[i] = self.names[b]
            scores[own] = np.clip(1.0 - ranked[:, 0] / lead, 0.0, 1.0)
        return names, scores


_CLEANER = _Cleaner()


def equal_part(lengths: list[int], total: int) -> int:
    """The largest part that texts can give, the shorter ones all they have, without more than `total` in sum."""
    left = total
    for done, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - done) > left:
            return left // (len(lengths) - done)
        left -= n
    return max(lengths, default=0)


def windows(text: str, part: int) -> str:
    """At most `part` characters of a text: windows at places given by hash, one in each of equal stretches of the whole text."""
    if len(text) <= part:
        return text
    count = max(1, part // WINDOW)
    size, stretch = part // count, len(text) // count
    seed = text.encode("utf-8", "surrogatepass")
    starts = [k * stretch + zlib.crc32(seed, k) % (stretch - size + 1) for k in range(count)]
    return "".join(text[at:at + size] for at in starts)


def learn(docs: DataFrame, modulus: int = 3, out: int = 1, sample_docs: int = 400, sample_chars: int = 30_000) -> Languages:
    """Automata from texts with a language whose crc32(doc_id) modulo `modulus` is not `out`.

    The labelled text of a language are windows all over up to `sample_docs` documents, chosen by a hash and in its order,
    `sample_chars` characters in all; each gives an equal part, or all it has. Only that reaches the driver.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (remainder("t_id", modulus) != out))
    rows = first_by_hash(rows, sample_docs, "lang")  # so the window has a bounded number of ids per language
    order = Window.partitionBy("lang").orderBy(F.xxhash64("t_id"), "t_id")
    ids = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_docs).select("t_id", "lang", "at").collect()
    wanted = spark.createDataFrame([(r.t_id, r.lang, r["at"]) for r in ids], "t_id bigint, t_lang string, at int")
    clean = F.pandas_udf(lambda c: c.map(lambda t: cleaned(t or "", _CLEANER)[1:]), "string")
    # An id that is repeated gives one of its texts.
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(wanted), (F.col("doc_id") == F.col("t_id")) & (F.col("lang") == F.col("t_lang"))).groupBy("lang", "at").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = stored(taken.select("lang", "at", clean("text").alias("text")).where("trim(text) != ''"), "language-sample")
    lengths: dict[str, list[int]] = {}
    for r in texts.select("lang", F.char_length("text").alias("n")).collect():
        lengths.setdefault(r.lang, []).append(r.n)
    parts = spark.createDataFrame([(n, equal_part(x, sample_chars)) for n, x in lengths.items()], "p_lang string, part int")
    cut = F.pandas_udf(lambda c, n: pd.Series([windows(t, k) for t, k in zip(c, n, strict=True)], dtype=object), "string")
    found = texts.join(F.broadcast(parts), F.col("lang") == F.col("p_lang")).select("lang", "at", cut("text", "part").alias("text")).collect()
    drop_stored(spark, texts)
    samples: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r.lang, r["at"])):
        samples[r.lang] = samples.get(r.lang, " ") + r.text
    return Languages({n: t for n, t in samples.items() if t.strip()})


def _scorer(spark: SparkSession, languages: Languages):
    shared = spark.sparkContext.broadcast(languages)  # at most 3 * sample_chars edges per language, each with 4 to 8 places of 12 bytes

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in parts:
            names, scores = [], []
            for at in range(0, len(column), 1000):
                n, s = shared.value.predict([t or "" for t in column.iloc[at:at + 1000]])
                names += n
                scores.append(s)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.empty(0)})

    return F.pandas_udf(of, "lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned from documents with a language whose crc32(doc_id as text) modulo 3 is not 1; those with 1 are held out. Only
    the whole text makes a prediction. Texts that are null or have no letter, and all texts where nothing could be learned,
    get `und` and score 0. The score is one less the ratio of the best to the second best estimate; ties go to the first name.
    A null doc_id counts as held out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = _scorer(spark, learn(docs))(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "found.lang_pred", "found.score")


def reference_phrases(text: str, sample: str) -> int:
    """Phrases of a normalised text by plain substring search, segment by segment, for tests.

    A character that the sample lacks begins a phrase that the match after it belongs to.
    """
    count = 0
    for at in range(0, len(text), SEGMENT):
        count, match = count + 1, ""
        for c in text[at:at + SEGMENT]:
            if match + c in sample:
                match += c
            else:
                count, match = count + 1, c if c in sample else ""
    return count
