import hashlib
import random

import pytest

from tidemark.llm.exact_dedup import drop_exact_copies, exact_dedup


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


def found(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("min_count", [2, 64])
def test_against_brute_force_with_hot_groups(documents, min_count):
    """Hot groups above and below the threshold give the same rows."""
    rng = random.Random(3)
    texts = ["HOT copy"] * 150 + ["Zwölf Ä", "zwölf Ä", "zwölf ä", None, "", "x" * 200_000] + [str(rng.randint(0, 40)) for _ in range(100)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = exact_dedup(documents(rows), min_count=min_count)
    assert found(df) == brute(rows)
    assert df.where("kept").count() == len({low(t) for _, t in rows})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in df.collect())


@pytest.mark.parametrize("copies", [3, 100])
def test_repeated_rows_and_null_ids(documents, copies):
    rows = [(5, "a")] * copies + [(None, "a"), (None, "b")]
    out = exact_dedup(documents(rows)).collect()
    assert len(out) == copies + 2 and sum(r.kept for r in out) == 2
    assert {r.keep_id for r in out} == {5, None}
    for options in ({}, {"max_broadcast_rows": 0}):
        kept = drop_exact_copies(documents(rows), **options)
        assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == ["(5, 'a')", "(None, 'b')"]


def test_same_id_other_text_and_columns(documents):
    docs = documents([(1, "a"), (1, "b"), (2, "A")])
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "b"), (2, "A")]


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0 and drop_exact_copies(documents([])).count() == 0
