"""Every stage of the pipeline against a plain version of it, on the rows that the stage before kept."""

import os
import random
import subprocess
import sys

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tetrarank.llm import exact_dedup, minhash, mixing, toxicity
from tetrarank.llm.common import stored
from tetrarank.llm.workloads import ORACLES, QUERIES, tokenizer_path

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "st", "vin", "do")]
    rows, labels = [], []
    for i in range(260):
        text = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(8, 90)))
        toxic = int(rng.random() < 0.2)
        rows.append([i, text + (" vileword vilewords" if toxic else "")])
        labels.append((i, 1, toxic))
    for i in range(0, 60, 3):
        rows.append([300 + i, rows[i][1].upper()])
        rows.append([400 + i, rows[i][1] + " end"])
    rows += [[900, None], [901, ""], [902, "one two"], [903, "long " * 5000]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    seen, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stored(stage(spark, seen, folder), f"test-{name}")
        kept[name] = seen
        if name != names[-1]:
            assert seen.columns == docs.columns
        if name == "toxicity":
            model = toxicity.learn(docs, labels)
            assert pairs(seen) == sorted((i, t) for i, t in pairs_raw(before) if model.score(t or "") < 0.5)
            toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
            assert len(toxic - {r.doc_id for r in seen.collect()}) >= 0.9 * len(toxic)
        elif name == "exact_dedup":
            stay = {g[0] for g in exact_dedup.reference_groups(pairs_raw(before)) if g[3]}
            assert {i for i, _ in pairs(seen)} == stay and seen.count() == len(stay) < before.count()
        elif name == "minhash_near_dedup":
            stay = {g[0] for g in minhash.reference_groups(pairs_raw(before)) if g[3]}
            assert {i for i, _ in pairs(seen)} == stay and seen.count() == len(stay) < before.count()
        elif name == "source_mixing":
            chosen = sorted(r.doc_id for r in mixing.mixed(before).collect())
            texts = dict(pairs_raw(before))
            assert pairs(seen) == [(i, texts[i]) for i in chosen]
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            size = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs_raw(before))
            out = seen.collect()
            assert sum(r.length for r in out) == size and len({r.row for r in out}) == before.count()
            places = {}
            for r in out:
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for parts in places.values():
                assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
            assert len(places) <= -(-size // 2048) + 1


def pairs_raw(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_run_equals_its_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns[:1] == ["doc_id"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_entry_works_without_the_operators(tmp_path):
    """The library's queries are there when subpackage and pipeline are not."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys\n"
            "class Absent:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('corpus_pipeline', 'tetrarank.llm')):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Absent())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert 'hybrid_rerank' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
