"""Operators against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.llm import exact_dedup, fingerprints, language_id, minhash, mixing, packing, passages, quality, suffix_dedup, toxicity, warc
from tetrarank.llm.anchors import Hashes, anchors
from tetrarank.llm.components import components
from tetrarank.llm.workloads import tokenizer_path

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, key int, t string, row string, "
          "node string, family string, block string, score string, found string, at int, epoch string, tokens string")


def words(rng, n):
    return " ".join(rng.choice(["ba", "Ce", "dido", "Fug", "hij", "kol", "minu", "opq"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with every odd case; ids are distinct but for one repeated row."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(30)]
    shared = words(rng, 110)
    out = list(enumerate(base, 1))
    out += [(100, base[3]), (101, base[3].upper()), (102, base[3]), (103, ""), (104, None), (105, " \n\t "), (106, "one"), (107, "one two"), (108, "ONE TWO"),
            (109, base[5] + "\n" + shared), (110, shared + " x " + base[6]), (111, words(rng, 4000)), (112, "É é ß 日本 " + base[7]), (113, "za " * 700), (114, "za " * 700 + "b"),
            (115, base[8] + " tail"), (116, base[8] + " tail more"), (117, "<|endoftext|> a  b\n\n c "), (118, shared)]
    return [(i, t, random.Random(i).choice(["en", "de", None]), random.Random(i).choice(["a", "b", None, "a", "a"]), None) for i, t in out]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x" if c != "key" and c != "at" else 3 for c in "digest key t row node family block score found at epoch tokens".split()]) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def got(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()} if columns else {tuple(r) for r in df.collect()}


def test_cuckoo_filter_inserts_deletes_and_grows():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    live = exact_dedup.LiveDigests(4)
    assert all(live.insert(d, i) for i, d in enumerate(digests)) and not live.insert(digests[7], 9000)
    assert live.filter.size >= 5000 // 4 and all(d in live.filter for d in digests) and live.content[digests[7]] == [2, 9000]
    assert not live.delete(digests[7]) and live.delete(digests[7]) and not live.delete(digests[7])
    assert all(live.delete(d) for d in digests[:7]) and len(live.content) == 4992
    assert all(d in live.filter for d in digests[8:]) and live.insert(digests[0], 1)


def test_exact_groups(spark, docs, rows, nothing):
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got(exact_dedup.exact_groups(docs), *names) == exact_dedup.reference_groups([r[:2] for r in rows])
    assert exact_dedup.exact_groups(nothing).count() == 0
    odd = frame(spark, [(None, "a", None, None, None), (5, "A", None, None, None), (5, "A", None, None, None), (None, "q", None, None, None)])
    out = sorted(map(tuple, exact_dedup.exact_groups(odd).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert out == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 1, True)], key=str)
    assert got(exact_dedup.drop_exact(odd), "doc_id", "text", "key") == {(5, "A", 3), (None, "q", 3)}
    assert exact_dedup.drop_exact(docs).columns == docs.columns


def test_exact_index_takes_changes(spark, docs):
    keyed = exact_dedup.digests(docs)
    index = exact_dedup.build_index(keyed.where("doc_id <= 20 or doc_id = 100"), 4)
    after = exact_dedup.update_index(index, keyed.where("doc_id = 102"), keyed.where("doc_id in (4, 100, 7, 106)"), 4)
    live = {d: n for _, d, n, _ in got(after)}
    want = {}
    for i, d in got(keyed.where("(doc_id <= 20 and doc_id not in (4, 7)) or doc_id = 102")):
        want[d] = want.get(d, 0) + 1
    assert live == want


def test_fingerprints_of_edits(spark, docs, rows, nothing):
    texts = {r[0]: r[1] or "" for r in rows}
    want = fingerprints.reference_edits([r[:2] for r in rows])
    out = fingerprints.edited_likeness(docs, blocks=5).collect()
    assert {r.doc_id: (r.edited_sha256, r.n_chars) for r in out} == want and len(out) == len(rows)
    order = sorted(texts)
    for k, i in enumerate(order):
        r = next(r for r in out if r.doc_id == i)
        nxt = texts[order[(k + 1) % len(order)]]
        n = len(texts[i]) // 4
        assert r.fingerprint == fingerprints.fingerprint_of(texts[i]).text()
        assert r.edited_fingerprint == fingerprints.fingerprint_of(texts[i][:len(texts[i]) - n] + nxt[:n]).text()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.edited_likeness(nothing).count() == 0
    alone = fingerprints.edited_likeness(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    odd = frame(spark, [(None, "ab", None, None, None), (3, "cdefgh", None, None, None), (3, "cdefgh", None, None, None), (4, "ijklmn", None, None, None)])
    assert sorted((str(r.doc_id), r.n_chars) for r in fingerprints.edited_likeness(odd).collect()) == [("3", 6), ("3", 6), ("4", 6), ("None", 2)]


def test_fingerprint_is_homomorphic():
    a, b, both = (fingerprints.fingerprint_of(t).text() for t in ("one two three four\nx", "five six seven\none", "one\nfive six seven\nx\none two three four"))
    assert fingerprints.combine(a, b) == both and fingerprints.combine(both, b, -1) == a
    assert fingerprints.likeness(fingerprints._lanes(a), fingerprints._lanes(a)) == 1.0


def test_likeness_of_a_line_repeated_often():
    known = fingerprints.WordHashes()
    whole, most = (fingerprints.fingerprint_of("\n".join(["one line again"] * n), known) for n in (40_000, 30_000))
    assert fingerprints.likeness(fingerprints._parts(whole), fingerprints._parts(most)) == pytest.approx(0.96)
    assert fingerprints.combine(most.text(), fingerprints.fingerprint_of("\n".join(["one line again"] * 10_000), known).text()) == whole.text()


def test_packing_keeps_ids_and_fills_sequences(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    packed = packing.pack_documents(docs, path, 256)
    out = packed.collect()
    places = {}
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    for i, all_ids in ids.items():
        own = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == i)
        assert sum(n for _, _, n in own) == len(all_ids) and all(n == 256 for _, _, n in own[1:]) and [p for p, _, _ in own] == list(range(len(own)))
    total = sum(map(len, ids.values()))
    assert len(places) <= -(-total // 256) + 2
    joined = {r.sequence_id: r.ids for r in packing.sequences(docs, packed, path).collect()}
    assert sorted(x for s in joined.values() for x in s) == sorted(x for s in ids.values() for x in s)
    assert packing.pack_documents(nothing, path).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 40, 300))[::-1]
    sequence, offset = packing.place(lengths, 40)
    gaps = {}  # the same rule, trying every gap
    for s, q, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        counts = np.bincount([g for g in gaps.values() if g], minlength=41)
        options = []
        for g in sorted({g for g in gaps.values() if g >= s}):
            after = counts.copy()
            after[g] -= 1
            after[g - s] += g > s
            options.append((int((after ** 2).sum()), g))
        gap = min(options)[1] if options else 40
        assert gaps.get(q, 40) == gap and o == 40 - gap
        gaps[q] = gap - s


def test_near_groups(spark, docs, rows, nothing, monkeypatch):
    want = minhash.reference_groups([r[:2] for r in rows], 4)
    names = ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(minhash.near_groups(docs, 4), *names) == want and any(not w[3] for w in want)
    assert minhash.near_groups(nothing).count() == 0
    odd = frame(spark, [(None, "a b", None, None, None), (7, "a b", None, None, None), (7, "a b", None, None, None), (9, "A  B", None, None, None)])
    assert got(minhash.near_groups(odd), *names) == {(None, 1, None, True), (7, 1, 7, True), (9, 1, 7, False)}
    assert minhash.drop_near(odd).columns == odd.columns


def test_near_groups_of_a_split_family(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 3)
    rng = random.Random(1)
    base = words(rng, 60).split()
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(60)] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(text), None, None, None))
    out = got(minhash.near_groups(frame(spark, rows), 4), "doc_id", "n_shingles", "component_id", "kept")
    assert out == minhash.reference_groups([r[:2] for r in rows], 4)


def test_guests_of_a_block_are_bounded(spark, monkeypatch):
    """Pages of one template, alike by half and mostly not linked: few visit other blocks, and no cell holds them all."""
    rng = random.Random(2)
    shared = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(200):
        own = [f"o{rng.randrange(10 ** 9)}" for _ in range(40)]
        if i % 10 == 9:  # linked with the page before it
            own = rows[-1][1].split()[60:-1] + ["other"]
        rows.append((i, " ".join(shared + own), None, None, None))
    for i in range(200, 320):  # and some hundred near copies of one page, the largest part
        rows.append((i, rows[0][1] + f" n{i}", None, None, None))
    seen = []
    plain = minhash._compared

    def watched(rows, width, percent, guests, label):
        seen.append((guests, rows.groupBy("family", "block").count().agg(F.max("count")).first()[0] or 0, rows.where("mark").count()))
        return plain(rows, width, percent, guests, label)

    monkeypatch.setattr(minhash, "_compared", watched)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 20)
    out = got(minhash.near_groups(frame(spark, rows), 4), "doc_id", "n_shingles", "component_id", "kept")
    assert out == minhash.reference_groups([r[:2] for r in rows], 4) and sum(not r[3] for r in out) == 140
    inside, across = seen
    assert across[0] and across[1] <= 80 and across[2] < 200  # before: nearly 200 pages in each of some 16 blocks

    # Guests beyond a block's bound are dealt to cells: all sets share their rarest shingle.
    seen.clear()
    monkeypatch.setattr(minhash, "rarest", lambda shingles, counters, percent: shingles)
    assert got(minhash.near_groups(frame(spark, rows), 4), "doc_id", "n_shingles", "component_id", "kept") == out
    assert seen[1][1] <= 80 and seen[1][2] > 1000


def test_components(spark):
    pairs = [(a, a + 1) for a in range(40)] + [(100, 101), (101, 102), (5, 5), (200, 100)]
    out = dict(got(components(spark.createDataFrame(pairs, "u bigint, v bigint"))))
    assert out == {**{a: 0 for a in range(41)}, **{a: 100 for a in (100, 101, 102, 200)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_anchors_stand_for_each_window_once():
    rng = random.Random(2)
    for text in ("".join(rng.choice("abc ") for _ in range(1500)), "ab " * 500, "a" * 900, "ab" * 300 + words(rng, 100)):
        data = text.encode()
        at, _, first, last = anchors(data, 400, Hashes(data))
        gram = Hashes(data).fixed(250)
        for p, a, z in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            assert all(s + int(np.argmin(gram[s:s + 151])) == p for s in range(a, z + 1))
        assert sum((last - first + 1).tolist()) == len(data) - 399


def test_repeated_spans(spark, docs, rows, nothing):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = suffix_dedup.reference_removal([r[:2] for r in rows])
    assert got(suffix_dedup.repeated_spans(docs), *names) == want and sum(w[2] > 0 for w in want) > 5
    assert suffix_dedup.repeated_spans(nothing).count() == 0
    text = words(random.Random(3), 200)
    odd = frame(spark, [(None, text, None, None, None), (7, "x" * 399, None, None, None), (8, text, None, None, None), (8, text, None, None, None)])
    out = sorted(map(str, got(suffix_dedup.repeated_spans(odd), "doc_id", "n_removed", "n_spans")))
    assert out == sorted(map(str, {(None, len(text), 1), (7, 0, 0), (8, len(text), 1)}))


def test_repeated_passages(spark, docs, rows, nothing):
    names = ["doc_id", "n_passages", "n_passage_words"]
    want = passages.reference_passages([r[:2] for r in rows])
    assert got(passages.repeated_passages(docs), *names) == want and len(want) > 5
    assert passages.repeated_passages(nothing).count() == 0
    rng = random.Random(8)
    short, once = " ".join(rng.choice("ab") for _ in range(51)), words(rng, 60)
    texts = [f"{words(rng, 30)} {short} {words(rng, 40)}", f"{words(rng, 9)}\n{short.upper()} {words(rng, 70)}\t{short}", " ".join(short.split()[:50]), f"{once} {words(rng, 5)} {once}",
             words(rng, 51), words(rng, 3000), f"{short} {words(rng, 20)}", None, ""]
    odd = [(i or None, t) for i, t in enumerate(texts)] + [(5, words(rng, 2999))] + [(20, "repeated " * 300)] * 30 + [(21, "repeated " * 80)]
    odd += [(100 + i, f"{words(rng, rng.randrange(20))} {once} {words(rng, rng.randrange(20))}") for i in range(40)]
    want = passages.reference_passages(odd)
    out = passages.repeated_passages(frame(spark, [(i, t, None, None, None) for i, t in odd])).collect()
    assert {(r.doc_id, r.n_passages, r.n_passage_words) for r in out} == want and len(out) == len(want) == 46
    assert [r.passages for r in out if r.doc_id == 1] == [[[9, 60], [130, 181]]]
    full = suffix_dedup.repeated_spans(frame(spark, [(i, t, None, None, None) for i, t in odd])).collect()  # short passages are marked, not removed
    assert len(full) == len(odd) and {(r.doc_id, r.n_passages, r.n_passage_words) for r in full if r.n_passages} == want
    assert [(r.n_removed, r.n_passage_words) for r in full if r.doc_id == 1] == [(0, 102)]


def test_index_family_merges_levels(spark):
    family = suffix_dedup.IndexFamily(spark)
    found = []
    for b in range(5):
        found.append(got(family.insert(spark.createDataFrame([(1, b), (2, b // 2), (3, 9)], "head bigint, gram bigint"))))
        assert [r for r, _ in family.levels] == [[0], [1], [1, 0], [2], [2, 0]][b]
    assert found == [set(), {(2, 0), (3, 9)}, {(3, 9)}, {(2, 1), (3, 9)}, {(3, 9)}]


def test_mixing_meets_weights(spark, docs, nothing):
    out = mixing.mixed(docs, block_tokens=50).collect()
    by, size = {}, {}
    for r in docs.select("source", mixing.tokens_of().alias("n")).collect():
        size[r.source] = size.get(r.source, 0) + r.n
    for r in out:
        by.setdefault(r.source, []).append(r)
    power = mixing.exponent(spark.createDataFrame([(n,) for n in size.values()], "tokens bigint"), sum(size.values()))
    raised = {s: (n / sum(size.values())) ** power for s, n in size.items()}
    for s, chosen in by.items():
        quota = round(sum(size.values()) * raised[s] / sum(raised.values()))
        at = sorted((r.stream_at, r.tokens) for r in chosen)
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[-1][0] < quota <= sum(at[-1])
    p = np.array([n / sum(size.values()) for n in size.values()])
    q = np.array([raised[s] / sum(raised.values()) for s in size])
    natural, wanted = -(p * np.log(p)).sum(), -(q * np.log(q)).sum()
    assert abs(wanted - (natural + 0.5 * (np.log(len(p)) - natural))) < 1e-4
    drawn = mixing.draw(docs, block_tokens=50)
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in out)
    assert mixing.mixed(nothing).count() == 0 and mixing.draw(nothing).count() == 0


def test_repeat_limit_raises_the_exponent(spark):
    sources = spark.createDataFrame([(1000,), (10,)], "tokens bigint")
    free, limited = (mixing.exponent(sources, 1010, 0.9, m) for m in (None, 2.0))
    assert free < limited <= 1 and abs(1010 * 10 ** limited / (10 ** limited + 1000 ** limited) / 10 - 2.0) < 1e-3


def test_warc_round_trip(spark, nothing):
    page = "<p>" + "ä" * 100 + "</p>"
    rows = [(4, "http://b.example.org/x?y=1", page), (2, "https://a.example.org/", page), (3, None, "short"), (9, "http://b.example.org/x?y=1", "short"), (5, "x y\r\nz", None),
            (None, "http://a.example.org", page), (6, "http://[bad", page + "!"), (2, "https://a.example.org/", page)]
    out = sorted(map(str, map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == page and i != 2
        want.append(str((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)))
    assert out == sorted(want)
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_index_finds_single_captures(spark):
    from tetrarank.llm.common import new_path

    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p{i}", f"page {i} " * 30) for i in range(400)], "page_id bigint, url string, html string")
    folder = new_path(spark, "warc-test")
    captures = warc.write_archive(warc.with_revisits(pages), folder)
    directory = warc.write_index(captures, folder, block=10, shard_rows=150)
    assert directory.count() >= 40
    wanted = spark.createDataFrame([(warc.url_key("http://h3.example.com/p3"), 3), (warc.url_key("http://h1.example.com/p399"), 399), ("com,nowhere)/", 1)], "key string, page_id bigint")
    found = warc.read_records(warc.find(wanted, directory, folder), folder).collect()
    assert [(r.page_id, r.payload.decode()) for r in found] == [(3, "page 3 " * 30)]


def test_warc_index_finds_captures_of_one_page_in_several_files(spark, tmp_path):
    rows = [("a)/", 1), ("z)/", 9)] + [("", None)] * 40 + [("m)/", 5)] * 40
    captures = spark.createDataFrame([(k, p, f"f{i % 3}", i, 10) for i, (k, p) in enumerate(rows)], warc.CAPTURES)
    folder = f"file://{tmp_path}/index"
    directory = warc.write_index(captures, folder, block=4, shard_rows=10)
    assert directory.select("index").distinct().count() > 4
    asked = spark.createDataFrame([("", None), ("m)/", 5), ("z)/", 9), ("m)/", 6), ("zz)/", 1)], "key string, page_id bigint")
    assert got(warc.find(asked, directory, folder), *captures.columns) == got(captures.where("key != 'a)/'"), *captures.columns)
    assert warc.find(asked, directory, folder).count() == 81


def test_url_keys():
    assert warc.url_key("https://User:x@Sub.Example.com:8080/a/b?q=1#f") == "com,example,sub)/a/b?q=1" and warc.url_key(None) == ""


def test_automaton_parses_like_substring_search():
    rng = random.Random(4)
    samples = {n: "".join(rng.choice(a) for _ in range(300)) for n, a in (("x", "abc "), ("y", "abd "))}
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 5, 80, 4300)]
    languages = language_id.Languages(samples)
    assert languages.phrases(texts).tolist() == [[language_id.reference_phrases(t, samples[n]) for n in languages.names] for t in texts]


def test_language_is_learned_from_whole_texts(spark):
    """A long banner, the same before all texts and mostly in another language, hides none of them."""
    rng = random.Random(8)
    banner = " ".join(rng.choice(["uma", "ovo", "ixo", "eka"]) + rng.choice("aeiou") for _ in range(700)) + " "
    kinds = {"en": ["water", "house", "thing", "lowest", "round"], "xx": ["bzyk", "krzew", "wczas", "szczyt", "chrzan"]}
    rows = []
    for i in range(120):
        lang = ("en", "xx")[i % 2]
        body = " ".join(rng.choice(kinds[lang]) for _ in range(2000))
        rows.append((i, body if zlib.crc32(b"%d" % i) % 3 == 1 else banner + body, lang, None, None))
    out = {r.doc_id: r for r in language_id.identify(frame(spark, rows)).collect()}
    assert all(out[r[0]].lang_pred == r[2] for r in rows if out[r[0]].held_out)


def test_windows_are_equal_parts():
    text = "".join(chr(0x4E00 + i) for i in range(5000))
    got = language_id.windows(text, 300)
    assert len(got) == 300 and sorted(got) == list(got) and min(got) < text[1250] and max(got) >= text[3750]
    assert language_id.windows("ab ", 300) == "ab " and len(language_id.windows(text, 40)) == 40
    assert language_id.equal_part([2, 10, 10], 12) == 5 and language_id.equal_part([2, 3], 100) == 3 and language_id.equal_part([], 9) == 0


def test_language_of_held_out_texts(spark, nothing):
    rng = random.Random(6)
    bank = {"en": ["the", "and", "which", "nothing"], "de": ["der", "und", "nicht", "schach"]}
    rows = [(i, " ".join(rng.choice(bank[n]) for _ in range(30)), n, None, None) for i in range(60) for n in [("en", "de")[i % 2]]]
    rows += [(900, None, "en", None, None), (901, "12 !?", "de", None, None), (None, "the and which", None, None, None)]
    out = language_id.identify(frame(spark, rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id is None or r.doc_id >= 900} == {900: "und", 901: "und", None: "en"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(3, "a b", None, None, None)])).collect()} == {"und"}


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.6)
        text = words(rng, rng.randrange(20, 60))
        if toxic:
            text += " " + rng.choice(["scumword", "scumwordy", "vilething"]) + " " + words(rng, 5)
        if not good:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, None, None, None))
        labels.append((i, good, toxic))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "scumword", None, None, None)]
    labels += [(1, None, None), (None, 1, 1), (5000, 0, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_toxicity_of_held_out_texts(spark, judged, nothing):
    docs, labels, truth = judged
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(out[i].predicted, t) for i, _, t in truth[:400] if out[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert out[1000].score == out[1001].score < 0.5 and all(0 <= r.score <= 1 for r in out.values()) and out[None].held_out
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id in (1000, 1001)").count() == 2


def test_risk_estimator_needs_no_negative_labels():
    rng = np.random.default_rng(0)
    noise = [rng.choice(5000, 40, replace=False).astype(np.uint32) + 10 for _ in range(900)]
    positive = [np.append(s, np.uint32(1)) for s in noise[:200]]
    unlabelled = [np.append(s, np.uint32(1)) if k < 140 else s for k, s in enumerate(noise[200:])]
    model = toxicity.fit(positive, unlabelled, 0.2)
    others = [abs(w) for f, w in model.weights.items() if f != 1]
    assert model.weights[1] > 3 * max(others) and model.bias < 0


def test_quality_of_held_out_texts(spark, judged, nothing):
    docs, labels, truth = judged
    out = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [(out[i].predicted, q) for i, q, _ in truth[2:400] if out[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in out.values())
    assert out[1000].score == out[1001].score and quality.quality(nothing, labels).count() == 0
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_tells_texts_of_one_form_apart():
    """The same shapes, lengths, repeats and marks; only the words, or only their order, differ."""
    rng = random.Random(4)
    kinds = (["stone", "river", "cloud", "grass"], ["deals", "bonus", "prize", "offer"])
    apart = [" ".join(rng.choice(kinds[i % 2]) for _ in range(80)) for i in range(80)]
    order = [" ".join(rng.choice(["we go", "to it"]) if i % 2 else rng.choice(["go we", "it to"]) for _ in range(200)) for i in range(80)]
    for texts in (apart, order):
        bags = [quality.term_counts(t, quality.Shapes()) for t in texts]
        space = quality.Space(bags[:60], np.arange(60) % 2, dimensions=8)
        assert ((space.score(texts[60:], quality.Shapes()) > 0.5) == (np.arange(20) % 2 == 1)).all()


def test_votes_follow_the_share_of_the_labels(spark):
    """Equal texts with three labels 0 to one label 1, of which the sample holds as many of each."""
    docs = spark.createDataFrame([(i, "the same words") for i in range(400)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) quality")
    space = quality.learn(docs, labels, most=40)
    kept = [r for r in labels.collect() if zlib.crc32(b"%d" % r.doc_id) % 4 != 2]
    assert len(space.labels) == 40 and space.labels.sum() == 20
    assert space.vote(space.vectors[:1], neighbours=40)[0] == pytest.approx(sum(r.quality for r in kept) / len(kept), abs=1e-4)


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(1)
    bags = [{int(k): 1 + int(k) % 3 for k in rng.choice(200, 20, replace=False)} for _ in range(80)]
    space = quality.Space(bags, np.arange(80) % 2, dimensions=8)
    vectors = space.fold(bags[:20])
    cosine = vectors @ space.vectors.T
    for row, score in zip(cosine, space.vote(vectors, neighbours=5, block=7), strict=True):
        near = np.argsort(-row)[:5]
        weight = np.maximum(row[near], 1e-3) ** 8
        assert abs(score - (weight * (near % 2)).sum() / weight.sum()) < 1e-4
