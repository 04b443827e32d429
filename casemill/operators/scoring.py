"""Anomaly scores against a reference population, with attribution; unit similarity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def share_up_to(df: DataFrame, reference: DataFrame, value: str, ref_value: str, out: str) -> DataFrame:
    """Adds the share of the reference that is at most the value: running counts over both, no cross join."""
    steps = reference.select(F.col(ref_value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    points = df.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct().withColumn("n", F.lit(0).cast("long"))
    both = steps.unionByName(points).groupBy("v").agg(F.sum("n").alias("n"))
    ranked = running(both, "v", "n", "_upto", "_all").select("v", (F.col("_upto") / F.col("_all")).alias(out))
    return df.join(ranked, F.col(value).cast("double").eqNullSafe(F.col("v")), "left").drop("v")


def tail_share(shares: Sequence[tuple[Column, Column]]) -> Column:
    """1 - the least tail over features, a tail being the smaller of both sides: pairs (share at most, share at least)."""
    tails = [F.least(a, b) for a, b in shares]
    return 1 - (tails[0] if len(tails) == 1 else F.least(*tails))


@dataclass(frozen=True)
class Forest:
    """Isolation forest (Liu, Ting and Zhou 2008) over a bounded sample."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    sample: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        limit = int(np.ceil(np.log2(max(sample, 2))))
        return cls(tuple(_tree(x[rng.choice(len(x), sample, replace=False)], limit, rng) for _ in range(trees)), sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows step down one tree at a time, all together; a row in a leaf stays there."""
        n = len(x)
        depth, rows, flat = np.zeros(n), np.arange(n), np.ascontiguousarray(x.T).ravel()
        for feature, cut, left, right, length in self.trees:
            nodes, leaf = np.arange(len(feature)), feature < 0
            kids = np.column_stack([np.where(leaf, nodes, right), np.where(leaf, nodes, left)]).ravel()
            column = np.where(leaf, 0, feature) * n
            at = np.zeros(n, np.int64)
            for _ in range(_height(feature, left, right)):
                at = kids.take(2 * at + (flat.take(column.take(at) + rows) < cut.take(at)))
            depth += length.take(at)
        return 2.0 ** (-(depth / len(self.trees)) / max(_mean_depth(self.sample), 1e-9))


def _height(feature: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Steps from the root to the deepest leaf."""
    level, steps = np.zeros(1, np.int64), -1
    while len(level):
        inner = level[feature[level] >= 0]
        level, steps = np.concatenate([left[inner], right[inner]]), steps + 1
    return steps


def _mean_depth(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, cut, left, right, length = [], [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for values, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (length, depth + _mean_depth(len(rows)))):
            values.append(v)
        low, high = rows.min(0), rows.max(0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            return me
        f = int(rng.choice(usable))
        c = rng.uniform(low[f], high[f])
        side = rows[:, f] < c
        if side.all() or not side.any():
            return me
        feature[me], cut[me] = f, c
        left[me] = grow(rows[side], depth + 1)
        right[me] = grow(rows[~side], depth + 1)
        return me

    grow(x, 0)
    return tuple(np.array(v) for v in (feature, cut, left, right, length))


def forest_score(df: DataFrame, features: Sequence[str], forest: Forest, out: str = "forest") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return df.withColumn(out, score(*[F.col(f).cast("double") for f in features]))


def ablation(features: dict[str, Column], medians: dict[str, float], score) -> Column:  # noqa: ANN001
    """Contribution of each feature: the score less the score with the feature at its median, as an array."""
    whole = score(features)
    parts = [F.struct(F.lit(name).alias("feature"), (whole - score(features | {name: F.lit(medians[name])})).alias("contribution")) for name in sorted(features)]
    return F.array(*parts)


def top_reasons(attributions: Column, least: float, n: int = 4) -> Column:
    """Features of at most n contributions of at least ``least``, the largest first, then by name.

    ``attributions`` are structs of feature, contribution, observed, expected, q1 and q3.  Without such a contribution the
    one feature that is farthest from its expected value is named, in units of the distance of its quartiles.
    """
    kept = F.filter(attributions, lambda x: x["contribution"] >= least)
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct((-x["contribution"]).alias("k"), x["feature"].alias("feature"))))
    spread = lambda x: F.greatest(F.abs(x["q3"] - x["q1"]), F.lit(1e-6))
    deviant = F.array_sort(F.transform(attributions, lambda x: F.struct((-F.abs(x["observed"] - x["expected"]) / spread(x)).alias("k"), x["feature"].alias("feature"))))
    return F.transform(F.when(F.size(keyed) > 0, F.slice(keyed, 1, n)).otherwise(F.slice(deviant, 1, 1)), lambda x: x["feature"])


def median(values: Column) -> Column:
    """The middle of an array of numbers, or the mean of both middle ones; null if it is empty."""
    v, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(F.array_sort(values), i.cast("int"))
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, F.get(v, F.floor(n / 2).cast("int"))).otherwise((at(n / 2 - 1) + at(n / 2)) / 2)


def quartiles(values: Column) -> Column:
    """Struct of q1, median and q3: medians of the halves without the middle (Tukey); of one value, that value."""
    v, n = F.array_sort(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    low, high = F.slice(v, 1, half), F.slice(v, n - half + 1, half)
    ends = lambda part, other: F.when(half > 0, median(part)).otherwise(other)
    return F.struct(ends(low, F.get(v, F.lit(0))).alias("q1"), median(values).alias("median"), ends(high, F.get(v, n - 1)).alias("q3"))


def mean_absolute(contributions: Column) -> Column:
    """Mean of the absolute contributions of an array of structs; 0 for none."""
    total = F.aggregate(contributions, F.lit(0.0), lambda s, x: s + F.abs(x["contribution"]))
    return F.when(F.size(contributions) > 0, total / F.size(contributions)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 if either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def rank_units(items: DataFrame, units: DataFrame, item: str, vector: str, unit: str, most_units: int = 2_000) -> DataFrame:
    """Adds ranked (score, unit), best first, ties by unit, and the margin between the first two.

    Units are a configured list: their number is checked, and they enter each row as one array.
    """
    if units.limit(most_units + 1).count() > most_units:
        raise ValueError(f"at most {most_units} units")
    all_units = units.agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("unit"), "centre"))).alias("_all"))
    joined = items.join(F.broadcast(all_units), F.lit(True), "left")
    scored = F.transform("_all", lambda u: F.struct((-cosine(F.col(vector), u["centre"])).alias("k"), u["unit"].alias("unit")))
    out = joined.withColumn("ranked", F.array_sort(scored)).drop("_all")
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return out.withColumns({"best_unit": first["unit"], "best_score": -first["k"], "margin": second["k"] - first["k"]})
