"""Source divergence, lexical search and secret scans against plain loops: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.llm import divergence, lexical, secrets, trigrams
from tetrarank.llm.terms import LETTERS, WORDS, terms

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, term string, rank int, rules string, block int, item string, "
          "value string, n string, z string, shards string, p int, q int")
ODD = ["", None, " \n\t ", "É é ß 日本 x1", "Aa aA 7 77 a", "ba " * 3000, "one", "ONE one\nOne"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5, "y", 3, "i", "v", "n", "z", "s", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["ba", "Ce", "dido", "Fug", "hij", "kol", "minu", "opq", "ß", "日本", "x1"]
    out = [(i, " ".join(rng.choice(words) * rng.randrange(1, 3) for _ in range(rng.randrange(1, 60)))) for i in range(90)]
    out += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, out[3][1]), (4, out[3][1]), (None, "ba kol"), (None, "ba kol")]
    return [(i, t, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None])) for i, t in out] + [(500, None, "fr", "a"), (501, "", "fr", "b"), (502, "rare", "it", "b")]


def words_of(text, digits):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def test_terms_are_those_of_the_pattern(spark, rows):
    import pyarrow as pa

    column = pa.array([None if t is None else t.encode() for _, t, _, _ in rows], pa.binary())
    for part in (column, column.slice(5, 40), column.slice(0, 0), pa.array([None, b""], pa.binary())):
        for table, digits in ((LETTERS, False), (WORDS, True)):
            found, row = terms(part, table)
            want = [(i, w) for i, t in enumerate(part.to_pylist()) for w in words_of((t or b"").decode(), digits)]
            assert list(zip(row.tolist(), [w.decode() for w in found.to_pylist()], strict=True)) == want


def plain_audit(rows, least, top):
    groups, count, df = {(g or "", s or "") for _, _, g, s in rows}, defaultdict(Counter), defaultdict(Counter)
    for _, t, g, s in rows:
        found = words_of(t, False)
        count[g or "", s or ""].update(found)
        df[g or ""].update(set(found))
    out = set()
    for lang, source in groups:
        kept = sorted(w for w, n in df[lang].items() if n >= least)
        of = {s: count[g, s] for g, s in groups if g == lang}
        sums = {s: sum(c[w] for w in kept) for s, c in of.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sums[s] + 5 * len(kept)) for w in kept} for s, c in of.items()}
        q = {w: 1 + 10**9 * (sum(c[w] for c in of.values()) + 5) // (sum(sums.values()) + 5 * len(kept)) for w in kept}
        pairs = sorted((-sum(abs(p[source][w] - p[s][w]) for w in kept), s.encode()) for s in of if s != source)
        over = sorted((q[w] - p[source][w], w.encode()) for w in kept if of[source][w] and p[source][w] > q[w])
        out |= {(lang, source, "pair", s.decode(), -v, i) for i, (v, s) in enumerate(pairs, 1)}
        out |= {(lang, source, "term", w.decode(), -v, i) for i, (v, w) in enumerate(over[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 50), (20, 2), (10**6, 50)])
def test_divergence(spark, rows, least, top):
    found = divergence.audit(frame(spark, rows), least, top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    listed = [tuple(r) for r in found.collect()]
    assert set(listed) == plain_audit(rows, least, top) and len(listed) == len(set(listed))


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_scatter_equals_all_terms_of_all_pairs():
    rng = np.random.default_rng(1)
    for peers, kept in ((1, 4), (7, 60), (30, 200)):
        held = rng.random((peers, kept)) < 0.3
        z = rng.integers(1, 900, peers)
        p = np.where(held, rng.integers(1, 10**9, (peers, kept)), z[:, None])
        group, term = np.nonzero(held)
        order = rng.permutation(len(group))
        sums = np.zeros((peers, peers), np.int64)
        for g, other, value in divergence.scatter(group[order], term[order], p[group, term][order], z, kept):
            sums[g, other] += value
            sums[other, g] += value
        assert (sums == np.abs(p[:, None] - p[None]).sum(axis=2)).all()


def plain_search(rows, items, k):
    docs = [(i, Counter(words_of(t, True))) for i, t, *_ in rows]
    n, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = defaultdict(list)
    for item, text in items:
        asked[item] += words_of(text, True)
    out = []
    for item, found in asked.items():
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in found if c[w])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "ba ce ce dido"), (2, "ONE"), (3, "unknown words"), (4, None), (5, "ß 日本 日本 é x1 7"), (6, "ba"), (6, "kol kol"), (None, "hij"), (7, "ba ce dido fug hij kol minu opq " * 4)]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search(spark, rows, tmp_path, k):
    path = f"file://{tmp_path}/index"
    lexical.build_index(frame(spark, rows).repartition(5), path)
    index = lexical.read_index(spark, path)  # kept, and searched without the documents
    assert index.size() == (sum(bool(words_of(t, True)) for _, t, *_ in rows), sum(len(words_of(t, True)) for _, t, *_ in rows))
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id bigint, text string, score int, doc_id int")
    found = sorted([tuple(r) for r in lexical.search(index, items, k).collect()], key=str)
    assert found == plain_search(rows, ITEMS, k)


def test_search_in_sets_of_items_is_the_same(spark, rows, monkeypatch):
    index = lexical.build_index(frame(spark, rows))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(lexical, "QUERY_TERMS", 10)
    assert sorted([tuple(r) for r in lexical.search(index, items, 4).collect()], key=str) == plain_search(rows, ITEMS, 4)


def test_search_of_nothing(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.search(lexical.build_index(frame(spark, [])), items).count() == 0
    assert lexical.search(lexical.build_index(frame(spark, rows)), items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_hybrid_evaluation_loses_nothing_and_skips(seed):
    rng = np.random.default_rng(seed)
    size, k = 3000, 20
    edges, lists, all_scores = lexical.edges_of(size), [], np.zeros(size, np.int64)
    for share in (0.001, 0.003, 0.01, 0.2, 0.5, 0.9):
        places = np.flatnonzero(rng.random(size) < share)
        scores = rng.integers(1, 10 if seed % 2 else 10**6, len(places)) * (1 + (places < 300) * 5)
        weight = int(rng.integers(1, 9))
        all_scores[places] += weight * scores
        lists.append((lexical.List.of(places, scores, edges), weight))
    want = sorted((-s, i) for i, s in enumerate(all_scores.tolist()) if s)[:k]
    for floor in (1, -want[-1][0]):
        seen = {}
        at, score = lexical.hybrid_top(lists, size, k, floor, seen)
        assert sorted(zip((-score).tolist(), at.tolist(), strict=True)) == want
        assert seed % 2 or seen["windows"] < len(edges) - 1  # some windows cannot reach the k-th best


def test_queries_of_expressions():
    def q(pattern, flags=re.ASCII):
        return trigrams.query_of(pattern, flags)

    def hit(pattern, text, flags=re.ASCII):
        have = {text.lower().encode()[i:i + 3] for i in range(len(text.encode()) - 2)}
        return q(pattern, flags) is None or bool(trigrams.holds(q(pattern, flags), lambda t: np.array([t in have]))[0])

    assert q("abcd") == ("and", frozenset([b"abc", b"bcd"])) and q("ABC") == b"abc"
    assert q("ab") is None and q("[0-9a-f]{24,}") is None and q("a.c") is None and q("(abc)?") is None and q("abc|de") is None
    assert q("abc|xyz") == ("or", frozenset([b"abc", b"xyz"])) and q("x(abc)*y") is None and q("(abc){2}") == trigrams.both(b"abc", b"bca", b"cab")
    assert q("a[bc]d") == ("or", frozenset([b"abd", b"acd"])) and q("abc.*xyz") == ("and", frozenset([b"abc", b"xyz"]))
    assert q(r"^\bfoo(?=bar)$") == b"foo" and q("(?:ab)+cd") == ("and", frozenset([b"abc", b"bcd"]))
    assert hit("api_?key", "apikey") and hit("api_?key", "API_KEY") and not hit("api_?key", "api key")
    with pytest.raises(ValueError, match="ASCII"):
        q("secret", re.IGNORECASE)
    rng = random.Random(8)  # whatever matches fulfils the query
    for pattern in ("ab?c(d|ef)*g", "(ab|cd)(ef|gh)[xyz]+q", "(a|bc|def){2,3}z", "a{3,}b{2}", "(ab*c|[a-d]e)f?gh", "(?:x|yz)+?abc|[^a]bcd"):
        for text in ("".join(rng.choice("abcdefghxyzq") for _ in range(400)) for _ in range(40)):
            m = re.search(pattern, text)
            if m:
                assert hit(pattern, text) and (len(m.group()) < 3 or hit(pattern, m.group()))


SECRETS = [
    "password = hunter22 Token:'abcdefg' secret=\"x\" API_KEY=abc.def/123==", "日本 passwd : ééé password==abcdef", "AKIA" + "Z9" * 8 + " AKIAshort AKIA" + "A" * 30,
    "deadbeef" * 3 + " " + "0" * 23 + " x" + "f" * 100, "ſecret=longenough toKen=longenough", "ghp_" + "a" * 36 + " eyJhbGciOiJI.eyJhbGciOiJI.abcdefghij", "token=AKIA" + "B" * 20,
    "-----BEGIN RSA PRIVATE KEY-----\nabc", "secret" * 5 + "=" + "a1" * 40, "pass word=abcdefg", "", None, "é" * 50 + "token=" + "0123456789abcdef" * 2, "x " * 40000 + "secret: abcdef",
]


def plain_scan(text, rules=secrets.RULES):
    spans = []
    for i, r in enumerate(rules):
        spans += [(m.start(), i, m.end()) for m in re.finditer(r.pattern, text or "", r.flags) if m.end(r.group) - m.start(r.group) >= r.least]
    return [(rules[i].name, a, b) for a, i, b in sorted(spans)]


def secret_rows(rows):
    return [(1000 + i, t, "en", "a") for i, t in enumerate(SECRETS)] + rows + [(1000, SECRETS[0], "x", "y"), (1000, "token: none here", "x", "y"), (None, SECRETS[0], "x", "y")]


def test_secret_scan(spark, rows):
    rows = secret_rows(rows)
    found = secrets.digest(secrets.scan(frame(spark, rows).repartition(3)))
    want = []
    for i, text, *_ in rows:
        spans = plain_scan(text)
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        joined = [",".join(f"{k}:{a}:{b}" for k, a, b in part) for part in (base, spans)]
        want.append((i, *[sum(s[0] == k for s in base) for k in ("assign", "access", "hex")], hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 10 and any("ghp" not in w[5] and "github" in w[5] for w in want)


def test_secret_sql(rows):
    docs = [(i, t) for i, t, *_ in secret_rows(rows)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = {(r[0], r[5]) for r in con.execute(secrets.oracle()).fetchall()}
    assert got == {(i, ",".join(f"{k}:{a}:{b}" for k, a, b in plain_scan(t))) for i, t in docs}


def test_kept_index_serves_rules_made_later(spark, rows, tmp_path):
    docs = frame(spark, secret_rows(rows)).where("doc_id is not null")
    index = secrets.build_index(docs.repartition(2), f"file://{tmp_path}/index")
    later = (secrets.Rule("pair", "minu.{0,20}kol"), secrets.Rule("any", "[a-c]{2}"), secrets.Rule("fug", "FUG", 0, 0, re.ASCII | re.IGNORECASE))
    hits = {r.doc_id: r.rules for r in secrets.candidates(index, later).collect()}
    texts = defaultdict(list)
    for i, t, *_ in secret_rows(rows):
        texts[i].append((t or "").lower())
    holds = {i: sum(b << n for n, b in ((0, any(re.search("minu", t) and "kol" in t for t in ts)), (2, any("fug" in t for t in ts)))) for i, ts in texts.items() if i is not None}
    assert hits == {i: b for i, b in holds.items() if b}  # read from the lists alone; the second rule has no sure trigram
    found = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.scan(docs, later, index).collect())
    assert found == sorted((i, plain_scan(t, later)) for i, t, *_ in secret_rows(rows) if i is not None)


def test_secret_scan_of_nothing(spark):
    assert secrets.digest(secrets.scan(frame(spark, []))).count() == 0


def test_trigrams_of_long_texts_go_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    raw, bounds = rng.integers(60, 100, 5000).astype(np.uint8), np.array([0, 0, 2, 7, 4000, 4001, 5000])
    whole = secrets._keys(raw, bounds)
    monkeypatch.setattr(secrets, "BLOCK_BYTES", 128)
    assert (secrets._keys(raw, bounds) == whole).all()
    want = {(int.from_bytes(bytes(raw[i:i + 3]).lower()), r) for r in range(6) for i in range(bounds[r], bounds[r + 1] - 2)}
    assert {(int(k) // 4096, int(k) % 4096) for k in whole} == want
