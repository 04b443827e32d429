"""Quality classifier as a sparse rule ensemble.

Shallow trees are grown on random parts of a labelled sample; every path from a
root to a node is a conjunctive rule over text statistics.  A logistic model with
a lasso penalty weighs the rules, which leaves few of them; those are compiled
into one Spark column, so that scoring is native.

Learning takes at most ``Settings.sample`` labelled rows, chosen by a hash of their
id; this bound is a parameter.  Rows held out by ``Settings.folds`` are never
learned from.  Inputs of a score are statistics of the text alone.

Cases: null and empty texts are scored by the same rules, with all counts 0; with
no labelled rows, or labels of one value only, the score is the share of label 1
with one success and one failure added; repeated rows are scored each; tables may
have further columns, none is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decision_list import FEATURES, ratios
from .shared import remainder
from .text_stats import with_counts


@dataclass(frozen=True)
class Settings:
    sample: int = 12_000
    folds: int = 5
    threshold: float = 0.3
    trees: int = 40
    depth: int = 3
    part: float = 0.5
    features: int = 4
    cuts: int = 32
    min_leaf: int = 10
    penalty: float = 0.002
    steps: int = 400
    seed: int = 3


#: feature number, True for "above", cut
Test = tuple[int, bool, float]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, tuple[Test, ...]], ...] = ()

    def column(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, tests in self.rules:
            hit = F.lit(True)
            for f, above, cut in tests:
                hit = hit & (values[FEATURES[f]] > cut if above else values[FEATURES[f]] <= cut)
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, tests in self.rules:
            total += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, cut in tests:
        hit &= x[:, f] > cut if above else x[:, f] <= cut
    return hit


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, s: Settings) -> tuple[int, float] | None:
    """The split with the lowest Gini impurity; its cut lies in the middle of a gap between values."""
    best, found = y.mean() * (1 - y.mean()) * len(y) - 1e-9, None
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.concatenate([[0], np.cumsum(y[order])])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= s.min_leaf) & (at <= len(y) - s.min_leaf)]
        if not len(at):
            continue
        left, right = ones[at] / at, (ones[-1] - ones[at]) / (len(y) - at)
        impurity = at * left * (1 - left) + (len(y) - at) * right * (1 - right)
        if impurity.min() < best:
            k = at[impurity.argmin()]
            best, found = impurity.min(), (int(f), float((v[k - 1] + v[k]) / 2))
    return found


def _paths(x: np.ndarray, y: np.ndarray, s: Settings, rng: np.random.Generator, path: tuple[Test, ...] = ()) -> list[tuple[Test, ...]]:
    if len(path) >= s.depth or len(y) < 2 * s.min_leaf or y.min() == y.max():
        return []
    split = _split(x, y, rng.choice(x.shape[1], size=min(s.features, x.shape[1]), replace=False), s)
    if split is None:
        return []
    f, cut = split
    out = []
    for above in (False, True):
        here = (*path, (f, above, cut))
        side = x[:, f] > cut if above else x[:, f] <= cut
        out += [here, *_paths(x[side], y[side], s, rng, here)]
    return out


def _lasso(rules: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient steps; the intercept has no penalty."""
    n, k = rules.shape
    a = np.hstack([np.ones((n, 1)), rules])
    rate = 4 * n / (np.linalg.norm(a, 2) ** 2 + 1e-9)
    w = np.zeros(k + 1)
    w[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    z, t = w.copy(), 1.0
    for _ in range(s.steps):
        gradient = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * s.penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def learn(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Ensemble:
    """An ensemble from statistics and 0/1 labels."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return Ensemble(base)
    rng = np.random.default_rng(s.seed)
    paths: dict[tuple[Test, ...], None] = {}
    for _ in range(s.trees):
        rows = rng.random(len(y)) < s.part
        paths |= dict.fromkeys(_paths(x[rows], y[rows], s, rng))
    columns, kept, seen = [], [], set()
    for path in paths:
        hit = _holds(x, path)
        if 0 < hit.sum() < len(y) and (key := hit.tobytes()) not in seen:
            seen.add(key)
            columns.append(hit)
            kept.append(path)
    if not kept:
        return Ensemble(base)
    intercept, weights = _lasso(np.stack(columns, axis=1).astype(float), y, s)
    return Ensemble(intercept, tuple((float(w), p) for w, p in zip(weights, kept, strict=True) if abs(w) > 1e-4))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Ensemble:
    """Learns ``labels.quality`` from labelled rows that are not held out."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), s.folds) != 0))
    marked = marked.select(F.col("doc_id").alias("id"), F.col("quality").alias("q"))
    chosen = marked.orderBy(F.xxhash64("id", F.lit(s.seed)), "id", "q").limit(s.sample)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(chosen), "id")
    values = ratios("c_")
    rows = with_counts(texts, "c_", "t").select("id", "q", *[values[f].alias(f) for f in FEATURES]).collect()
    rows.sort()
    table = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), len(FEATURES) + 2)
    return learn(table[:, 2:], table[:, 1], s)


def scored(docs: DataFrame, model: Ensemble, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    counted = with_counts(docs.select("doc_id", "text"), "c_")
    out = counted.select("doc_id", (remainder(F.col("doc_id"), s.folds) == 0).alias("held_out"), model.column(ratios("c_")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= s.threshold, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    return scored(docs, fit(docs, labels, s), s)
