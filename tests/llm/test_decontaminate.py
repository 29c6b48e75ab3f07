import hashlib
import random
import re

import pytest

from tidemark.llm.decontaminate import contamination, drop_contaminated, find_contamination, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed=4):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", "of", "é", "a1", *[f"w{rng.randint(0, 60)}"]]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "!!"), (None, text(20)), (33, items[6][1]), (5, items[5][1]), (34, "the the the"), (35, "é é")]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(own) - 10))
            parts += [" ".join(own[a:]).upper(), text(rng.randint(0, 30))]
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "the " * 5000), (None, items[0][1]), (7, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("most_blocks", [1 << 20, 1])
def test_against_brute_force(spark, documents, most_blocks):
    docs, items = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(documents(docs), benchmark, most_blocks=most_blocks).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=str)
    assert got == brute(docs, items)


def test_spans_of_the_general_interface(spark, documents):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    (r,) = find_contamination(documents([(1, "x A, b! c y a b c a b c")]), benchmark).collect()
    assert r.spans == [[1, 4], [5, 11]] and r["items"] == ["1"]


def test_empty_tables_and_columns(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b"), (None, "c")])
    assert [r.n_hit for r in contamination(docs, none).collect()] == [0, 0]
    assert contamination(documents([]), none).count() == 0
    bad = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = drop_contaminated(docs, bad)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["c"]


def test_words_follow_the_pattern():
    rng = random.Random(9)
    for _ in range(500):
        t = "".join(chr(rng.choice([rng.randint(0, 127), 0xE9, 0x4E2D, 0x1F600])) for _ in range(30))
        assert [w.decode() for w in words_of(t.encode())] == words(t)


def test_rows_are_dropped_by_their_own_texts(spark, documents):
    leak = " ".join(f"leak{i}" for i in range(20))
    rows = [(1, leak), (1, "clean one"), (None, leak), (None, "clean two"), (2, None), (3, leak.upper())]
    items = spark.createDataFrame([(7, leak), (8, "other words " * 9)], "item_id long, text string")
    docs = documents(rows)
    for options in ({}, {"max_broadcast_rows": 0}):
        kept = drop_contaminated(docs, items, **options)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
