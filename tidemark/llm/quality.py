"""Quality classifier: a sparse rule ensemble, compiled to Spark column expressions.

Small boosted trees are grown over text statistics of a bounded labelled sample.  Every
path from a root to a node becomes a conjunctive rule.  A lasso-penalised logistic
regression over the rules keeps few of them, and those are compiled into one column
expression over the statistics, which are column expressions themselves.  Scoring runs
inside Spark without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import fold, labelled_sample

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

Condition = tuple[str, bool, float]  # statistic, whether it must exceed, bound


NAMES = (
    "log_chars", "mean_word", "letters", "capitals", "digits", "marks", "stops", "bars", "line_words", "distinct_lines", "distinct_words",
)


def with_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """(row, s): the rows as structs, and the statistics of their texts (null: empty) as a struct.

    Defined for empty texts.  What several statistics share is a column of an earlier step, so
    it is computed once.  Letters, then digits, are taken out of the text; the other marks are
    counted in what is left.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    row = df.select(F.struct("*").alias("row"), t.alias("t"))
    cut = row.select(
        "row",
        F.length("t").alias("chars"),
        F.length(F.regexp_replace("t", r"\p{Lu}+", "")).alias("no_capitals"),
        F.regexp_replace("t", r"\p{L}+", "").alias("no_letters"),
        F.split("t", "\n").alias("lines"),
        F.split("t", r"\s+").alias("words"),
    )
    cut = cut.select("*", F.regexp_replace("no_letters", r"\p{N}+", "").alias("rest"))
    cut = cut.select("*", F.regexp_replace("rest", r"[\s.,]+", "").alias("marks"))
    n = F.greatest("chars", F.lit(1)).cast("double")
    words, lines = F.size("words").cast("double"), F.size("lines").cast("double")
    of = lambda c, mark: F.length(c) - F.length(F.replace(F.col(c), F.lit(mark), F.lit("")))
    values = (
        F.log1p(F.col("chars").cast("double")),
        F.col("chars") / words,
        (F.col("chars") - F.length("no_letters")) / n,
        (F.col("chars") - F.col("no_capitals")) / n,
        (F.length("no_letters") - F.length("rest")) / n,
        F.length("marks") / n,
        of("rest", ".") / words,
        of("marks", "|") / words,
        words / lines,
        F.size(F.array_distinct("lines")) / lines,
        F.size(F.array_distinct("words")) / words,
    )
    return cut.select("row", F.struct(*[v.alias(k) for k, v in zip(NAMES, values, strict=True)]).alias("s"))


@dataclass
class RuleModel:
    """Rules (conjunctions of conditions) with weights, and the intercept."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self, stats: str = "s") -> Column:
        """The probability of label 1 as a column expression over the struct ``stats``."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                value = F.col(f"{stats}.{name}")
                holds = holds & ((value > cut) if above else (value <= cut))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, out: list) -> list:
    """Splits ``rows`` greedily by gain; appends each node's path to ``out``; returns [(rows, value)]."""
    if path:
        out.append(path)
    leaf = [(rows, -g[rows].sum() / (h[rows].sum() + 1.0))]
    if depth == 0 or len(rows) < 20:
        return leaf
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best = (1e-3, None, None)
    for f, bounds in enumerate(cuts):
        if not len(bounds):
            continue
        place = np.searchsorted(bounds, x[rows, f], side="left")  # <= bounds[place]
        left_g = np.bincount(place, g[rows], len(bounds) + 1).cumsum()[:-1]
        left_h = np.bincount(place, h[rows], len(bounds) + 1).cumsum()[:-1]
        left_n = np.bincount(place, minlength=len(bounds) + 1).cumsum()[:-1]
        right_g, right_h = g[rows].sum() - left_g, h[rows].sum() - left_h
        gain = left_g**2 / (left_h + 1.0) + right_g**2 / (right_h + 1.0) - whole
        gain[(left_n < 10) | (len(rows) - left_n < 10)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, bounds[k])
    if best[1] is None:
        return leaf
    _, f, cut = best
    goes = x[rows, f] <= cut
    down = []
    for side, above in ((rows[goes], False), (rows[~goes], True)):
        down += _grow(x, g, h, cuts, side, depth - 1, (*path, (f, above, float(cut))), out)
    return down


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3) -> list[tuple]:
    """The distinct paths of ``trees`` boosted trees, as tuples of (feature, above, cut).

    Cuts lie midway between neighbouring quantiles, so a gap between classes is split evenly.
    """
    values = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 66))) for f in range(x.shape[1])]
    cuts = [(v[:-1] + v[1:]) / 2 for v in values]
    z, paths = np.zeros(len(y)), []
    for _ in range(trees):
        p = _sigmoid(z)
        for rows, value in _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), depth, (), paths):
            z[rows] += rate * value
    return list(dict.fromkeys(paths))


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n = len(y)
    a = np.hstack([r.astype(float), np.ones((n, 1))])
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / np.linalg.norm(a @ v) ** 2
    w = ahead = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = ahead - size * (a.T @ (_sigmoid(a @ ahead) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 12, depth: int = 3, penalty: float = 1e-3) -> RuleModel:
    """A rule model of rows of statistics; with one class or no rows a constant."""
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], float(np.log(p / (1 - p))))
    paths = tree_rules(x, y, trees, depth)
    if not paths:
        p = y.mean()
        return RuleModel([], float(np.log(p / (1 - p))))
    weights, intercept = lasso_logistic(np.column_stack([_holds(x, p) for p in paths]), y, penalty)
    rules = [
        (tuple((names[f], above, cut) for f, above, cut in path), float(w))
        for path, w in zip(paths, weights, strict=True)
        if abs(w) > 1e-6
    ]
    return RuleModel(rules, intercept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
          label_col: str = "quality", sample_rows: int = 20_000, **options) -> RuleModel:
    """Fits on at most ``sample_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, label_col, FOLDS, HELD_OUT, sample_rows, id_col, text_col)
    rows = with_statistics(sample, "text").select("row.doc_id", "row.label", "s.*").toArrow().sort_by("doc_id")
    x = np.column_stack([rows.column(k).to_numpy() for k in NAMES]) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows.column("label").to_numpy().astype(float), list(NAMES), **options)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any text by their statistics, texts of any length
    whole.  A null id is never held out.  Repeated rows come back repeated, an empty table gives
    an empty result, and other columns are not looked at.  Without labelled rows every score
    is 0.5.
    """
    model = train(docs, labels, id_col, text_col, **options)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_statistics(own, "text").select(
        "row.doc_id",
        F.coalesce(fold(F.col("row.doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        model.score().alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows predicted 0; all columns as they were; no shuffle."""
    model = train(docs, labels, id_col, text_col, **options)
    # the number keeps the optimiser from pushing the filter below, where it would compute each statistic anew
    scored = with_statistics(docs, text_col).select("row", model.score().alias("p"), F.monotonically_increasing_id().alias("n"))
    return scored.where((F.col("p") >= THRESHOLD) & (F.col("n") >= 0)).select("row.*")
