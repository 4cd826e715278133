"""JSON documents cut by byte ranges: the same rows as whole documents, whatever the borders cut through."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tetrarank.sources import json_split, readers

rng = random.Random(4)
STRINGS = ["", "plain", "a}b{c", "quote \" and \\", "\\\\", "[1, 2], {", "é日本}", "tab\t\n}", "x" * 300, "\\\"}", "ends with \\"]


def value(depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(STRINGS)
    if kind < 4:
        return [rng.randrange(10**6), None, True, 1.5, rng.choice(STRINGS)][rng.randrange(5)]
    if kind == 4:
        return [value(depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(STRINGS) + str(i): value(depth + 1) for i in range(rng.randrange(4))}


LIST = [{"id": i, "s": rng.choice(STRINGS), "v": value()} for i in range(300)] + [[], {}, "text }", 5, None, ["}"], {"id": 1, "s": "again", "v": 0}]
OBJECT = {f"k{i}}}{{\"": value() for i in range(300)}


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("3001b", "1b"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(found, wanted):
    return sorted(json.dumps(json.loads(x), sort_keys=True) for x in found) == sorted(json.dumps(x, sort_keys=True) for x in wanted)


@pytest.mark.parametrize("indent", [None, 1])
def test_members(spark, tmp_path, small_ranges, indent):
    for name, document in (("l", LIST), ("o", OBJECT), ("e", []), ("f", {}), ("n", [1, "a", None])):
        (tmp_path / f"{name}.json").write_text("\n " + json.dumps(document, indent=indent, ensure_ascii=False) + ("" if indent else "\n"))
        parts, kind = json_split.members(spark, str(tmp_path / f"{name}.json"))
        assert kind == ("[" if isinstance(document, list) else "{")
        texts = [r.text for r in parts.collect()]
        if kind == "[":
            assert same(texts, document)
        else:
            assert same(["{" + t + "}" for t in texts], [{k: v} for k, v in document.items()])
    assert json_split.pieces(spark, str(tmp_path / "l.json")).select("start").distinct().count() > 8  # many ranges, members over their borders
    (tmp_path / "text.json").write_text('"text"')
    with pytest.raises(ValueError, match="expected"):
        json_split.members(spark, str(tmp_path / "text.json"))


def test_several_files(spark, tmp_path, small_ranges):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(LIST[i * 50:i * 50 + 90]))
    assert same([r.text for r in json_split.members(spark, str(tmp_path))[0].collect()], [x for i in range(3) for x in LIST[i * 50:i * 50 + 90]])


@pytest.mark.parametrize("place", ["first", "middle", "last", "short"])
def test_list_inside(spark, tmp_path, small_ranges, place):
    other = {f"m{i}": {"items": [i], "t": "\"movies\": ["} for i in range(150)}
    wanted = LIST if place != "short" else LIST[:3]
    document = {"first": {"items": wanted, **other}, "last": {**other, "items": wanted}}.get(place, {**other, "data": {"not": "a list"}, "items": wanted, "after": [other] * 3})
    (tmp_path / "d.json").write_text(json.dumps(document))
    found = json_split.list_inside(spark, str(tmp_path / "d.json"), ["movies", "data", "items"])
    assert same([r.text for r in found.collect()], wanted)
    (tmp_path / "p.json").write_text(json.dumps(other))
    assert json_split.list_inside(spark, str(tmp_path / "p.json"), ["movies", "data"]) is None


def test_readers_give_the_same_rows_either_way(spark, tmp_path, small_ranges, monkeypatch):
    table = [{"a": i, "b": rng.choice(STRINGS), "c": [i, i + 1]} for i in range(400)]
    ranking = {f"p{i}": [{"movieId": j, "score": j / 2, "reason": rng.choice(STRINGS)} for j in range(rng.randrange(5))] + [{"score": 1}] for i in range(150)}
    prompts = {f"q{i}": rng.choice([f"text {i}", {"query": f"nested {i}"}, {"text": "", "prompt": "}"}]) for i in range(200)}
    emotions = {"note": "x", "movies": [{"movieId": i, "title": f"t{i}", "emotions": {"joy": i % 7, "fear": 1}} for i in range(120)]}
    for name, document in (("t", table), ("r", ranking), ("p", prompts), ("l", [{"prompt_id": k, "text": str(v)} for k, v in prompts.items()]), ("e", emotions)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) for x in emotions["movies"]))

    def rows(df):
        return sorted(json.dumps(r, sort_keys=True) for r in df.toJSON().collect())

    def read():
        path = str(tmp_path)
        return [rows(x) for x in (
            readers.read_table(spark, f"{path}/t.json"), readers.read_table(spark, f"{path}/t.json", "a long, b string"), readers.read_rankings(spark, f"{path}/r.json"),
            readers.read_prompts(spark, f"{path}/p.json"), readers.read_prompts(spark, f"{path}/l.json"),
            readers.read_emotion_source(spark, f"{path}/e.json").withColumn("emo", F.transform("emo", lambda x: F.round(x, 9))),
            readers.read_emotion_source(spark, f"{path}/lines.json").withColumn("emo", F.transform("emo", lambda x: F.round(x, 9))))]

    whole = read()
    monkeypatch.setattr(readers, "WHOLE_FILE_BYTES", 0)
    assert read() == whole and min(map(len, whole)) > 100


def test_outside_of_strings():
    for _ in range(300):
        text = json.dumps([value(), value()], ensure_ascii=False).encode()
        free, inside = json_split.outside(np.frombuffer(text, np.uint8), False)
        assert not inside
        level, skip, expected = False, False, []
        for c in text:
            expected.append(not level and c != 34)
            if skip:
                skip = False
            elif c == 92:
                skip = True
            elif c == 34:
                level = not level
        assert free.tolist() == expected
