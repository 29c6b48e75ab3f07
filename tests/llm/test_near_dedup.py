import random

import numpy as np
import pytest

from tidemark.llm import setsketch as sk
from tidemark.llm.components import components
from tidemark.llm.near_dedup import keep_one_of_each, near_dedup


def shingles(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=4, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted((i, len(s), find(i) if i is not None else None) for i, s in sets if i is not None)


def corpus(seed=5, families=12, size=9):
    """Families of near copies whose similarities lie on both sides of the limit, chains among them."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy  # a chain: copies of copies
    texts += ["", None, " \n\t", "One two", "one  TWO", "x", "w" * 100_000, "w " * 30_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell_shingles", [1 << 18, 600])
def test_against_brute_force(documents, cell_shingles):
    rows = corpus()
    out = near_dedup(documents(rows), width=4, cell_shingles=cell_shingles, max_broadcast_ids=0 if cell_shingles == 600 else 10**6)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_hot_group_of_near_copies(documents):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i in range(60) for k in [rng.randrange(100)]]
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    out = near_dedup(documents(rows), width=4)
    assert {r.component_id for r in out.collect()} == {0}


def test_nulls_repeats_empty(documents):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "a b c d e"), (None, None), (9, None)]
    out = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in near_dedup(documents(rows)).collect())))
    assert out == ["(1, 1, True)", "(3, 1, False)", "(3, 1, False)", "(9, 9, True)", "(None, None, True)", "(None, None, True)"]
    docs = documents(rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert near_dedup(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(2000, 2000 + i) for i in range(1, 80)] + [(2079 - i, 2079) for i in range(40)]
    edges += [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
    df = spark.createDataFrame(edges, "u long, v long")
    for options in ({}, {"least_hub": 3, "most_hubs": 10**6}):  # without hubs, and with most nodes taken for hubs
        assert {r.node: r.component for r in components(df, **options).collect()} == want
    assert components(df.where("false")).count() == 0


def test_sketch_merges_estimates_and_loses_no_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    a, b = sk.registers(x[:2000]), sk.registers(x[1000:])
    assert (np.maximum(a, b) == sk.registers(x)).all()
    for n in (30, 300, 3000):  # similarity 0.8 shares a band and is admitted, 0.2 is not admitted
        hits = admitted = wrong = 0
        for _ in range(60):
            y = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            u, v = y[: int(n * 0.9)], y[n - int(n * 0.9) :]
            r = np.stack([sk.registers(u), sk.registers(v)])
            k = sk.band_keys(r)
            hits += (k[0] == k[1]).any()
            size = np.array([len(u)])
            admitted += sk.may_reach(r[:1], r[1:], size, size, 0.8)[0]
            z = sk.registers(np.concatenate([u[: len(u) // 3], rng.integers(0, 1 << 64, len(u) - len(u) // 3, dtype=np.uint64)]))
            wrong += sk.may_reach(r[:1], z[None], size, size, 0.8)[0]
        assert hits == admitted == 60 and wrong == 0


def test_texts_of_one_id_are_judged_apart(documents):
    rng = random.Random(4)
    prose = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    a, b, c, d = prose(), prose(), prose(), prose()
    near = lambda words: " ".join(words[:-1] + ["last"])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (3, near(b)), (4, " ".join(c)), (4, " ".join(d)), (5, near(d)), (6, near(c))]
    out = near_dedup(documents(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4), (5, 4), (6, 4)]
    kept = {(r.doc_id, r.text) for r in keep_one_of_each(documents(rows)).collect()}
    assert kept == {rows[0], rows[2], rows[4], rows[5]}
