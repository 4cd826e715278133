"""Text embedding as a batch job with a pluggable encoder, and proxy scores for prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.constants import EXPERTS
from tetrarank.functions import text as tx
from tetrarank.functions import vectors as vx
from tetrarank.operators.blocks import DECIMALS, ITEM_ROWS, Scorer, list_matrix, top_k_scores


def windows(tokens: Column, size: int, stride: int) -> Column:
    """Overlapping token windows that cover the whole text; the last one ends with the text."""
    step = max(1, size - stride)

    def cut(t: Column) -> Column:
        count = F.greatest(F.ceil((F.size(t) - size) / F.lit(float(step))) + 1, F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(t, (i * step + 1).cast("int"), size))

    return vx.let(tokens, cut)


def embed_hashed(texts: DataFrame, key: str, text: str, dim: int = 64, window: int = 512, overlap: int = 64,
                 name: str = "embedding") -> DataFrame:
    """Hashed term counts per window, averaged over the windows of a text and scaled to unit length.

    A word's place is its md5 modulo `dim`. The mean over windows counts each word once per window that
    covers it, so no window is built: words are weighted by position and added up by place, with
    partial sums on the way. Texts without tokens get a zero vector.
    """
    step = max(1, window - overlap)
    size, place = F.col("__n"), F.col("__at")
    count = F.greatest(F.ceil((size - window) / F.lit(float(step))) + 1, F.lit(1))
    covering = F.least(count - 1, F.floor(place / step)) - F.greatest(F.ceil((place - window + 1) / F.lit(float(step))), F.lit(0)) + 1
    listed = texts.select(key, tx.tokens(F.col(text)).alias("__t")).select(key, F.size("__t").alias("__n"), F.posexplode_outer("__t").alias("__at", "__w"))
    slot = F.pmod(F.conv(F.substring(F.md5("__w"), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sums = listed.groupBy(key, slot.alias("__d")).agg(F.sum(covering / count).alias("__v"))
    packed = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("__d").isNotNull(), F.struct("__d", "__v")))).alias("__m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.try_element_at("__m", d), F.lit(0.0)))
    return packed.select(key, vx.l2_normalize(dense).cast("array<float>").alias(name),
                         F.lit(f"hashing-md5-{dim}").alias(f"{name}_model"), F.lit(dim).alias(f"{name}_dim"))


def embed_with(texts: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
               model: str, name: str = "embedding", normalize: bool = True, window: int = 0, overlap: int = 0) -> DataFrame:
    """Embeddings from any encoder: `load()` runs once per task and returns encode(list of texts).

    With `window`, texts are cut into overlapping windows of that many white-space words, each is encoded, and
    a text gets the mean of its windows' vectors, scaled to unit length if `normalize`.
    """
    key_type = texts.schema[key].dataType.simpleString()
    if window:
        words = F.split(tx.strip(tx.or_empty(F.col(text))), r"\s+")
        cut = texts.select(key, F.posexplode(windows(words, window, overlap)).alias("__window", "__words"))
        parts = embed_with(cut.select(F.struct(key, "__window").alias("__part"), F.array_join("__words", " ").alias(text)),
                           "__part", text, load, dim, model, name, normalize)
        mean = vector_to_array(Summarizer.mean(array_to_vector(vx.as_double(F.col(name)))))
        out = parts.groupBy(F.col(f"__part.{key}").alias(key)).agg(mean.alias(name))
        vector = vx.l2_normalize(F.col(name)) if normalize else F.col(name)
        return out.select(key, vector.cast("array<float>").alias(name), F.lit(model).alias(f"{name}_model"), F.lit(dim).alias(f"{name}_dim"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            vectors = np.asarray(encode(frame[text].fillna("").tolist()), dtype=np.float64)
            if normalize:
                vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + vx.EPS)
            yield pd.DataFrame({key: frame[key], name: list(vectors.astype(np.float32)),
                                f"{name}_model": model, f"{name}_dim": dim})

    schema = f"{key} {key_type}, {name} array<float>, {name}_model string, {name}_dim int"
    return texts.select(key, text).mapInPandas(run, schema)


# --- proxy scores ---------------------------------------------------------------------------------

SIGNALS = ["plot", "lexical", "history", "emotion"]


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def proxy_scores(rows: DataFrame) -> DataFrame:
    """Signals of given (prompt, item) rows: plot, lexical, history, emotion and their weighted sum.

    Needs prompt columns target_genres, negative_genres, prompt_tokens, liked_genres, disliked_genres,
    prompt_emo, w_* and item columns genres, title_tokens, item_emo.
    """
    def share(wanted: str) -> Column:
        return F.size(F.array_intersect("genres", wanted)) / F.greatest(F.size(wanted), F.lit(1))

    plot = (F.when(F.size("target_genres") > 0, share("target_genres")).otherwise(0.5)
            - F.when(F.size("negative_genres") > 0, 0.5 * share("negative_genres")).otherwise(0.0))
    words = F.array_distinct("prompt_tokens")
    lexical = F.when(F.size(words) > 0, jaccard(words, F.col("title_tokens"))).otherwise(0.0)
    liked = F.when(F.size("liked_genres") > 0, jaccard(F.col("genres"), F.col("liked_genres"))).otherwise(0.0)
    disliked = F.when(F.size("disliked_genres") > 0, jaccard(F.col("genres"), F.col("disliked_genres"))).otherwise(0.0)
    scored = rows.withColumns({
        "plot": F.least(F.greatest(plot, F.lit(0.0)), F.lit(1.0)), "lexical": lexical,
        "history": F.greatest(liked - disliked, F.lit(0.0)), "emotion": vx.dot(F.col("item_emo"), F.col("prompt_emo"))})
    combined = sum((F.col(f"w_{e}") * F.col(s) for e, s in zip(EXPERTS[1:], SIGNALS[1:])), F.col("w_alpha") * F.col("plot"))
    return scored.withColumn("combined", combined)


def _codes(table: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
    """Distinct values per row of a list column, flattened, with their rows."""
    array = table.column(column).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    rows = np.repeat(np.arange(len(array)), pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
    flat = array.flatten()
    if not len(flat):
        return flat, rows
    codes = flat.dictionary_encode()
    pairs = np.unique(rows * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False))
    return codes.dictionary.take(pa.array(pairs % len(codes.dictionary))), pairs // len(codes.dictionary)


def _matrix(values: pa.Array, rows: np.ndarray, vocabulary: pa.Array, n: int) -> np.ndarray:
    out = np.zeros((n, max(1, len(vocabulary))), np.float32)
    at = pc.fill_null(pc.index_in(values, vocabulary), -1).to_numpy(zero_copy_only=False)
    out[rows[at >= 0], at[at >= 0]] = 1.0
    return out


#: Pairs that a task looks at together, and what a bound may be off by rounding scores.
PAIRS, SLACK = 500_000, 2.0 * 10.0 ** -DECIMALS
#: A pair of a prompt and a set of words takes as long as so many pairs in a matrix.
DENSE = 4
#: Prompts and items that meet in a cell where prompts are too many to be broadcast.
CELL_PROMPTS, CELL_ITEMS = 100_000, 300_000


def _sets(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Number of each row's set of values, in the order of their first rows, and the sets."""
    values, rows = _codes(table, column)
    number = np.zeros(table.num_rows, np.int64)
    if len(values):
        code = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((code, rows))
        code, rows = code[order], rows[order]
        size = np.bincount(rows, minlength=table.num_rows)
        start = np.cumsum(size) - size
        for j in range(size.max()):  # rows whose first j values are equal have one number so far
            at = np.flatnonzero(size > j)
            both = number[at] * (code.max() + 1) + code[start[at] + j]
            number[at] = number.max() + 1 + np.unique(both, return_inverse=True)[1]
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lists = table.column(column).take(pa.array(first[order])).to_pylist()
    return place[number], pa.array([list(dict.fromkeys(x or ())) for x in lists], table.schema.field(column).type)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the runs that begin at `start`, each with the number of its run."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) + np.repeat(start - np.cumsum(size) + size, size)


def _pieces(size: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive parts whose sizes add up to about `most`."""
    part = (np.cumsum(size) - size) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(size)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]))


class _Proxy(Scorer):
    """Combined proxy score of a block of prompts against a block of items, as set-overlap matrix products.

    The genre parts are the same for items with the same genres, so they are computed once per set of genres of the block; and so
    are the title words. With the range of each emotion over the items of a set of genres this gives bounds: only sets of genres, then
    sets of words, and at last items that can be among the k best of a prompt are looked at.
    """

    item_rows, bounded = CELL_ITEMS, True

    def left(self, prompts: pa.Table) -> dict:
        names = ("target_genres", "negative_genres", "prompt_tokens", "liked_genres", "disliked_genres")
        codes = {c: _codes(prompts, c) for c in names}
        return {"n": prompts.num_rows, "codes": codes, "words": {c: pc.unique(codes[c][0]) for c in names},
                "size": {c: np.bincount(codes[c][1], minlength=prompts.num_rows).astype(np.float64)[:, None] for c in names},
                "emo": list_matrix(prompts.column("prompt_emo")), "weight": {e: prompts.column(f"w_{e}").to_numpy()[:, None] for e in EXPERTS}}

    def right(self, items: pa.Table) -> dict:
        kind, genres = _sets(items, "genres")
        worded, words = _sets(items, "title_tokens")
        codes = {"genres": (*_codes(pa.table({"genres": genres}), "genres"), len(genres)), "title_tokens": (*_codes(items, "title_tokens"), items.num_rows)}
        out = {"kind": kind, "codes": codes, "emo": list_matrix(items.column("item_emo")),
               "size": {c: np.bincount(rows, minlength=n).astype(np.float64)[None, :] for c, (_, rows, n) in codes.items()}}
        # Items in the order of (set of genres, set of words); equal ones are a group.
        both = kind * len(words) + worded
        order = np.argsort(both, kind="stable")
        group, start, size = np.unique(both[order], return_index=True, return_counts=True)
        of, first = np.unique(group // max(1, len(words)), return_index=True)
        values, rows = _codes(pa.table({"words": words}), "words")
        n_words = np.bincount(rows, minlength=len(words))
        held, emo = n_words[group % max(1, len(words))], out["emo"][order]
        at = start[first]
        return out | {"order": order, "start": start, "items": size, "genres": of, "first": first, "groups": np.diff(first, append=len(group)), "word_set": group % max(1, len(words)),
                      "words": values, "n_words": n_words, "first_word": np.cumsum(n_words) - n_words, "sorted_emo": emo,
                      "low": np.minimum.reduceat(emo, at) if len(at) else emo, "high": np.maximum.reduceat(emo, at) if len(at) else emo,
                      "fewest": np.minimum.reduceat(held, first) if len(at) else held, "most": np.maximum.reduceat(held, first) if len(at) else held,
                      "kind_items": np.diff(at, append=len(order)), "table": items, "some": {}}

    def some(self, left: dict, rows: np.ndarray) -> dict:
        """A prepared block of prompts with only those at `rows`."""
        place = np.full(left["n"], -1)
        place[rows] = np.arange(len(rows))
        kept = {c: place[at] >= 0 for c, (_, at) in left["codes"].items()}
        return {"n": len(rows), "codes": {c: (values.filter(pa.array(kept[c])), place[at[kept[c]]]) for c, (values, at) in left["codes"].items()}, "words": left["words"],
                "size": {c: x[rows] for c, x in left["size"].items()}, "emo": left["emo"][rows], "weight": {e: x[rows] for e, x in left["weight"].items()}}

    @staticmethod
    def _overlap(left: dict, right: dict, p_column: str, i_column: str) -> np.ndarray:
        values, rows, n = right["codes"][i_column]
        vocabulary = left["words"][p_column]
        return (_matrix(*left["codes"][p_column], vocabulary, left["n"]) @ _matrix(values, rows, vocabulary, n).T).astype(np.float64)

    def _similarity(self, left: dict, right: dict, p_column: str, i_column: str) -> np.ndarray:
        both = self._overlap(left, right, p_column, i_column)
        union = left["size"][p_column] + right["size"][i_column]
        union -= both
        return np.divide(both, np.maximum(union, 1.0, out=union), out=both)  # 0 where either set is empty

    def _genre_parts(self, left: dict, right: dict) -> np.ndarray:
        """Weighted plot and history of each prompt and set of genres."""
        wanted, unwanted = left["size"]["target_genres"], left["size"]["negative_genres"]
        plot = np.where(wanted > 0, self._overlap(left, right, "target_genres", "genres") / np.maximum(wanted, 1.0), 0.5)
        plot = plot - np.where(unwanted > 0, 0.5 * self._overlap(left, right, "negative_genres", "genres") / np.maximum(unwanted, 1.0), 0.0)
        history = np.maximum(self._similarity(left, right, "liked_genres", "genres") - self._similarity(left, right, "disliked_genres", "genres"), 0.0)
        return left["weight"]["alpha"] * np.clip(plot, 0.0, 1.0) + left["weight"]["gamma"] * history

    def scores(self, left: dict, right: dict) -> np.ndarray:
        weight = left["weight"]
        out = self._similarity(left, right, "prompt_tokens", "title_tokens")
        out *= weight["beta"]
        out += np.take(self._genre_parts(left, right), right["kind"], axis=1)
        emotion = left["emo"] @ right["emo"].T
        emotion *= weight["delta"]
        out += emotion
        return out

    def hits(self, left: dict, right: dict, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(right["order"]):
            return
        emo, low, high = left["emo"], right["low"], right["high"]
        beta, delta = left["weight"]["beta"], left["weight"]["delta"]
        if not (np.isfinite(low).all() and np.isfinite(high).all()):
            yield from self._all(left, right, least, k)
            return
        size, genre = left["size"]["prompt_tokens"], self._genre_parts(left, right)[:, right["genres"]]
        plus, minus = np.maximum(emo, 0.0), np.minimum(emo, 0.0)
        ends = delta * (plus @ high.T + minus @ low.T), delta * (plus @ low.T + minus @ high.T)
        top, bottom = np.maximum(*ends), np.minimum(*ends)
        # Of n and m words at most min(n, m) are shared and at least max(n, m) are in the union.
        shared = np.minimum(1.0, np.minimum(right["most"] / np.maximum(size, 1.0), size / np.maximum(right["fewest"], 1.0)))
        sure = genre + np.minimum(beta, 0.0) + bottom
        least = least - SLACK
        best = np.full(left["n"], -np.inf)
        if len(of := np.flatnonzero(right["kind_items"] >= k)):
            best = np.fmax(best, sure[:, of].max(axis=1))
        if sure.shape[1] >= k:
            best = np.fmax(best, np.partition(sure, -k, axis=1)[:, -k])
        vocabulary = left["words"]["prompt_tokens"]
        asked = np.hstack([_matrix(*left["codes"]["prompt_tokens"], vocabulary, left["n"]), np.zeros((left["n"], 1), np.float32)])
        code = pc.fill_null(pc.index_in(right["words"], vocabulary), -1).to_numpy(zero_copy_only=False)

        def grouped(p: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(prompt, set of genres, group, score without emotions) of the groups of (prompt, set of genres) pairs."""
            run, group = _spread(right["first"][kind], right["groups"][kind])
            q, of = p[run], kind[run]
            words = right["word_set"][group]
            held, both = right["n_words"][words], np.zeros(len(q))
            for j in range(held.max(initial=0)):
                at = np.flatnonzero(held > j)
                both[at] += asked[q[at], code[right["first_word"][words[at]] + j]]
            return q, of, group, genre[q, of] + beta[q, 0] * (both / np.maximum(size[q, 0] + held - both, 1.0))

        fresh = np.flatnonzero(~np.isfinite(least))
        least = np.fmax(least, best - SLACK)
        if len(of) and len(fresh):  # the best set of genres gives most prompts a threshold
            seed = of[np.argmax(np.nan_to_num((genre + np.maximum(beta, 0.0) * shared + top)[np.ix_(fresh, of)], nan=-np.inf), axis=1)]
            for part in _pieces(right["groups"][seed], PAIRS):
                q, kind, group, known = grouped(fresh[part], seed[part])
                least = self._raised(least, q, known + bottom[q, kind], right["items"][group], k)
        p, kind = np.nonzero(genre + np.maximum(beta, 0.0) * shared + top >= least[:, None])
        if DENSE * right["groups"][kind].sum() > left["n"] * len(right["order"]):
            yield from self._all(left, right, least, k)
            return
        for part in _pieces(right["groups"][kind], PAIRS):
            q, of, group, known = grouped(p[part], kind[part])
            least = self._raised(least, q, known + bottom[q, of], right["items"][group], k) if len(fresh) else least
            good = np.flatnonzero(known + top[q, of] >= least[q])
            q, group, known = q[good], group[good], known[good]
            for some in _pieces(right["items"][group], PAIRS):
                run, at = _spread(right["start"][group[some]], right["items"][group[some]])
                found = q[some][run]
                score = known[some][run] + delta[found, 0] * np.einsum("ij,ij->i", emo[found], right["sorted_emo"][at])
                good = np.flatnonzero(score >= least[found])
                yield found[good], right["order"][at[good]], score[good]

    def _all(self, left: dict, right: dict, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hits of matrices over all items, some at a time: bounds leave out too little, or there are none."""
        items = right["table"]
        for at in range(0, items.num_rows, ITEM_ROWS):
            if at not in right["some"]:
                right["some"][at] = self.right(items.slice(at, ITEM_ROWS))
            scores = np.nan_to_num(self.scores(left, right["some"][at]), nan=-np.inf, posinf=-np.inf)
            if scores.shape[1] >= k:
                least = np.fmax(least, np.partition(scores, -k, axis=1)[:, -k] - SLACK)
            q, i = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            yield q, i + at, scores[q, i]

    @staticmethod
    def _raised(least: np.ndarray, q: np.ndarray, sure: np.ndarray, items: np.ndarray, k: int) -> np.ndarray:
        """Thresholds, higher where k items have no less for sure."""
        order = np.lexsort((-sure, q))
        q, sure, items = q[order], sure[order], items[order]
        before = np.cumsum(items) - items
        first = np.searchsorted(q, q)
        upto = before - before[first] + items if len(q) else items
        at = np.flatnonzero((upto >= k) & (upto - items < k))
        out = least.copy()
        out[q[at]] = np.fmax(out[q[at]], sure[at] - SLACK)
        return out


_proxy_matrix = _Proxy()


def proxy_top_items(prompts: DataFrame, items: DataFrame, k: int, prompt_id: str = "prompt_id",
                    item_id: str = "item_id", **options) -> DataFrame:
    """k best items per prompt by the combined proxy score, over all items, block by block."""
    options = {"block_rows": CELL_PROMPTS, "item_rows": CELL_ITEMS} | options
    return top_k_scores(prompts, items, _proxy_matrix, k, query_id=prompt_id, item_id=item_id, score="combined", **options)


