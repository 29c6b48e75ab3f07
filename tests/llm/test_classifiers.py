import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import NAMES, fit, keep_good, lasso_logistic, score_quality, tree_rules, with_statistics
from tidemark.llm.toxicity import BITS, fit_logistic, ngram_buckets, score_toxicity
from tidemark.llm.toxicity import train as train_toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=8):
    """Prose, junk in capitals and marks, and prose with a rude word; labels for most."""
    rng = random.Random(seed)
    words = [a + b for a in ("th", "er", "an", "in", "st") for b in ("en", "ou", "ea", "ble", "ing")]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good, rude = rng.random() > 0.25, rng.random() < 0.3
        if rude:
            text[rng.randrange(len(text))] = rng.choice(["wretch", "lousy", "filthy"])
        body = " ".join(text) + "." if good else " ".join(w.upper() + "!!" for w in text)
        docs.append((i, body))
        if i % 10:
            labels.append((i, int(good), int(rude)))
    return docs, labels


def accuracy(rows, docs, which):
    truth = {i: int(any(w in t.lower() for w in ("wretch", "lousy", "filthy"))) if which == "toxic" else int("!!" not in t) for i, t in docs}
    held = [r for r in rows if r.held_out]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


@pytest.mark.parametrize(("score", "which", "folds", "out"), [(score_quality, "quality", 5, 0), (score_toxicity, "toxic", 4, 2)])
def test_held_out_accuracy_and_contract(spark, documents, score, which, folds, out):
    docs, labels = corpus()
    rows = score(documents([*docs, (None, None), (9001, ""), (9002, "w" * 100_000), docs[0]]), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) + 4
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out)
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 9000]
    assert accuracy(own, docs, which) > 0.97


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_held_out_labels_are_never_learned(spark, documents, score):
    """Turning the held-out labels round changes no score."""
    docs, labels = corpus(200)
    folds, out = (5, 0) if score is score_quality else (4, 2)
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == out else (i, q, t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in score(documents(docs), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, None, None), (None, 0, 0), (1, 0, 0)]])
def test_few_labels_and_empty_tables(spark, documents, score, labels):
    table = spark.createDataFrame(labels, LABELS)
    rows = score(documents([(1, "a"), (2, None)]), table).collect()
    assert len(rows) == 2 and len({r.score for r in rows}) == 1
    assert score(documents([]), table).count() == 0


def test_keep_good_keeps_columns_and_good_documents(spark, documents):
    docs, labels = corpus()
    df = documents(docs)
    kept = keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    good = {i for i, t in docs if "!!" not in t}
    assert len(good - {r.doc_id for r in kept.collect()}) <= 2 and len({r.doc_id for r in kept.collect()} - good) <= 5


def test_compiled_rules_equal_the_rules(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    model = fit(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < len(tree_rules(x, y, 12, 3)) + 1
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r.p for r in df.select(F.struct("*").alias("s")).select(model.score().alias("p")).collect()]
    at = {"a": 0, "b": 1, "c": 2}
    for row, s in zip(x, got, strict=True):
        z = model.intercept + sum(w for rule, w in model.rules if all((row[at[f]] > c) == above for f, above, c in rule))
        assert math.isclose(s, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert np.mean((np.array(got) >= 0.5) == (y == 1)) > 0.98


def brute_statistics(t):
    t = t or ""
    words, lines, n = re.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n"), max(len(t), 1)
    kind = [unicodedata.category(c) for c in t]
    return [
        math.log1p(len(t)),
        len(t) / len(words),
        sum(k[0] == "L" for k in kind) / n,
        sum(k == "Lu" for k in kind) / n,
        sum(k[0] == "N" for k in kind) / n,
        sum(k[0] not in "LN" and c not in " \t\n\x0b\f\r.," for c, k in zip(t, kind, strict=True)) / n,
        t.count(".") / len(words),
        t.count("|") / len(words),
        len(words) / len(lines),
        len(set(lines)) / len(lines),
        len(set(words)) / len(words),
    ]


def test_statistics_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, "\n\n", "A. B|c 12,5\n\nx x", "Éß½Ⅷ中 ٣!!", "a\u00a0b  c ", "|.,|..", "x" * 100_000]
    texts += ["".join(rng.choice("aB1 .,|!\n\té中") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "extra", 0) for i, t in enumerate(texts)], "row int, t string, s string, words int")
    found = {r.i: list(r.s) for r in with_statistics(df, "t").select(F.col("row.row").alias("i"), "s").collect()}
    assert len(NAMES) == len(found[0])
    for i, t in enumerate(texts):
        assert np.allclose(found[i], brute_statistics(t), rtol=1e-12), t


def test_filtering_computes_each_statistic_once(spark, documents):
    docs, labels = corpus(200)
    plan = keep_good(documents(docs), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 4 and "lambda" not in plan.replace("lambdafunction", "")


def test_lasso_weights_are_optimal():
    """Brute force: no step along any coordinate lowers the penalised loss."""
    rng = np.random.default_rng(4)
    r = rng.random((120, 4)) < 0.5
    y = (r[:, 0] | (rng.random(120) < 0.2)).astype(float)
    w, b = lasso_logistic(r, y, 0.02, steps=4000)

    def loss(v):
        z = r @ v[:-1] + v[-1]
        return np.mean(np.logaddexp(0, z) - y * z) + 0.02 * np.abs(v[:-1]).sum()

    best, at = loss(np.append(w, b)), np.append(w, b)
    for i in range(5):
        for step in (1e-2, -1e-2, 1e-3, -1e-3):
            assert loss(at + step * np.eye(5)[i]) >= best - 1e-7
    assert (w == 0).any()


def test_logistic_regression_against_brute_force():
    """The fit on lists of features equals a plain gradient descent on the dense matrix, in chunks of any size."""
    rng = np.random.default_rng(7)
    x = rng.random((60, 12)) < 0.3
    x[5] = False
    y = (x[:, 0] | (rng.random(60) < 0.1)).astype(float)
    ratio = rng.normal(size=12)
    flat, sizes = np.nonzero(x)[1].astype(np.int32), x.sum(axis=1)
    a, w = np.hstack([x * ratio, np.ones((60, 1))]), np.zeros(13)
    for _ in range(60_000):
        g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / 60
        g[:-1] += 1e-2 * w[:-1]
        w -= 0.3 * g
    for chunk in (1, 7, 1 << 20):
        weights, intercept = fit_logistic(flat, sizes, y, ratio, rounds=200, l2=1e-2, chunk=chunk)
        assert np.allclose(np.append(weights, intercept), w, atol=1e-4)


def test_the_model_is_linear_in_distinct_ngrams(spark, documents):
    """Brute force: every bucket that the sample has weighs in, once a text."""
    docs, labels = corpus(200)
    model = train_toxicity(documents(docs), spark.createDataFrame(labels, LABELS))
    score = model.scorer()
    for _, text in docs[:40]:
        z = model.intercept + sum(float(model.table[b]) for b in set(ngram_buckets(text.encode()).tolist()))
        assert math.isclose(score(text.encode()), 1 / (1 + math.exp(-z)), rel_tol=1e-6)
    assert score(b"") == score(None) and score(b"Wretch!") == score(b"  wretch ")
    learned = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    seen = {b for i, t in docs if i in learned for b in ngram_buckets(t.encode()).tolist()}
    assert len(seen) > 500 and set(np.flatnonzero(model.table)) <= seen and len(model.table) == 1 << BITS
    assert np.count_nonzero(model.table) > 0.9 * len(seen)
