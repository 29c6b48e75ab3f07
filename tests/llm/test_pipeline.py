"""The stages on planted cases, each against brute force on its own input."""

import importlib.util
import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import low
from tests.llm.test_near_dedup import brute as components

REPO = Path(__file__).parents[2]


def word(rng):
    return rng.choice("bcdfghlmnprst") + rng.choice("aeiou") + rng.choice("bcdlmnrst") + str(rng.randint(0, 9)) * rng.randint(0, 1)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    prose = lambda n: " ".join(word(rng) for _ in range(n)) + "."
    docs, labels = [], []
    for i in range(400):
        text = prose(rng.randint(20, 80))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(i % 4 != 0), 0))
    docs += [(1000 + k, docs[k][1].capitalize() if k % 8 == 1 else docs[k][1]) for k in range(1, 40, 4)]  # copies
    docs += [(2000 + k, docs[k][1] + " tail") for k in range(2, 60, 4)]  # near copies
    items = [(i, prose(30)) for i in range(6)]
    docs += [(3000 + i, prose(20) + " " + t) for i, t in items] + [(4000, prose(400) + " " + items[0][1][:40]), (4001, None), (4002, "")]
    d = tmp_path_factory.mktemp("sf")
    full = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(path)
        after = {r.doc_id for r in docs.collect()}
        if name == "quality":
            clean = {i for i, t in before.items() if t and "!!" not in t}
            assert clean <= after and len(after & {i for i, t in before.items() if t and "!!" in t}) <= 3
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[low(t)] = max(i, best.get(low(t), i))
            assert after == set(best.values())
        elif name == "near_dedup":
            assert after == {i for i, _, c in components(list(before.items()), width=5) if i == c}
        elif name == "decontaminate":
            assert after == {r[0] for r in contaminated(list(before.items()), items) if not r[5]}
            assert 4000 in after and not {3000 + i for i in range(6)} & after
        else:
            assert after == set(before) and docs.where("not round_trip or not parity").count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = after
    whole = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == seen[corpus_pipeline.STAGES[-1][0]]


def test_the_rest_stands_without_llm(tmp_path):
    """__spark_entry__ imports and offers the other queries where llm and the pipeline are gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tidemark.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'dedupe_latest' in e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_entry_offers_all_queries():
    spec = importlib.util.spec_from_file_location("entry", REPO / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= names
