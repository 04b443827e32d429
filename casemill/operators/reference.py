"""A reference population as an artifact: fitted, written, read back and compared; items scored against it in one pass.

The population is a bounded number of rows, chosen by a hash of their id, so that it fits into each task as sorted arrays.
An item has two readings: the rank of its isolation depth among the population's, and one less the smallest two-sided tail of
its deviating features.  Its score is the share of the population whose larger reading is at most its own.  All of that is
one batch-wise function of the item's features, whatever the number of features.

The artifact's text is canonical: rows by id, numbers rounded, keys sorted; the same population gives the same bytes, in any
order and layout.  Scores in it are recomputed when it is read, and the largest difference is its drift.

Cases: an item with a missing feature has no score; rows of the population with a missing feature are left out; other
features than declared, rows of another width and an empty population are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import ranked
from .scoring import Forest

DECIMALS = 6


@dataclass(frozen=True)
class Reference:
    names: tuple[str, ...]
    deviating: tuple[str, ...]
    ids: tuple[str, ...]
    rows: np.ndarray
    seed: int = 42
    trees: int = 200
    recorded: tuple[float, ...] = ()

    @cached_property
    def forest(self) -> Forest:
        return Forest.fit(self.rows, self.trees, seed=self.seed)

    @cached_property
    def columns(self) -> dict[str, np.ndarray]:
        return {n: np.sort(self.rows[:, self.names.index(n)]) for n in self.deviating}

    @cached_property
    def depths(self) -> np.ndarray:
        return np.sort(self.forest.score(self.rows))

    @cached_property
    def combined(self) -> np.ndarray:
        return np.sort(np.maximum(*self.readings(self.rows)))

    def readings(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the isolation score, and one less the smallest tail."""
        rank = np.searchsorted(self.depths, self.forest.score(x), "right") / len(self.rows)
        tail = np.ones(len(x))
        for name, ordered in self.columns.items():
            v = x[:, self.names.index(name)]
            below, above = np.searchsorted(ordered, v, "right"), len(ordered) - np.searchsorted(ordered, v, "left")
            tail = np.minimum(tail, np.minimum(below, above) / len(ordered))
        return rank, np.round(1 - tail, DECIMALS)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.combined, np.maximum(*self.readings(x)), "right") / len(self.rows)

    def document(self) -> str:
        scores = [round(float(v), DECIMALS) for v in self.score(self.rows)]
        whole = {"deviating": list(self.deviating), "feature_names": list(self.names), "item_count": len(self.ids), "row_ids": list(self.ids), "rows": self.rows.tolist(), "scores": scores, "seed": self.seed, "trees": self.trees}
        return json.dumps(whole, sort_keys=True, separators=(",", ":"))

    def drift(self) -> float:
        """The largest gap between recorded and recomputed scores of equal rank."""
        return float(np.abs(np.sort(self.recorded) - np.sort(self.score(self.rows))).max()) if self.recorded else 0.0


def fit(df: DataFrame, key: Column, names: Sequence[str], deviating: Sequence[str], *, most: int = 2_000, seed: int = 42, trees: int = 200) -> Reference:
    """A population of at most ``most`` rows, those with the smallest MD5 of their id."""
    numbers = [F.col(n).cast("double").alias(n) for n in names]
    chosen = df.select(key.cast("string").alias("_id"), *numbers).where(" and ".join(["_id is not null", *(f"`{n}` is not null and not isnan(`{n}`)" for n in names)]))
    found = sorted(tuple(r) for r in chosen.orderBy(F.md5("_id"), "_id", *names).limit(most).collect())
    if not found:
        raise ValueError("the reference population is empty")
    return Reference(tuple(names), tuple(deviating), tuple(r[0] for r in found), np.array([[round(v, DECIMALS) for v in r[1:]] for r in found]), seed, trees)


def write(spark: SparkSession, reference: Reference, path: str) -> str:
    """Writes the artifact as one line of text; returns its digest."""
    text = reference.document()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return hashlib.sha256(text.encode()).hexdigest()


def read(spark: SparkSession, path: str, declared: Sequence[str]) -> Reference:
    return parsed("\n".join(r["value"] for r in spark.read.text(path).collect()), declared)


def parsed(text: str, declared: Sequence[str]) -> Reference:
    d = json.loads(text)
    if d["feature_names"] != list(declared):
        raise ValueError("the reference population has other features")
    if not d["rows"] or {len(r) for r in d["rows"]} != {len(declared)} or not len(d["rows"]) == len(d["row_ids"]) == len(d["scores"]):
        raise ValueError("the reference population is empty or has rows of another width")
    return Reference(tuple(d["feature_names"]), tuple(d["deviating"]), tuple(d["row_ids"]), np.array(d["rows"], float), d["seed"], d["trees"], tuple(d["scores"]))


def scored(df: DataFrame, reference: Reference) -> DataFrame:
    """Adds ``forest_rank``, ``deviation`` and ``score``; null where a feature is missing."""
    shared = df.sparkSession.sparkContext.broadcast(reference)

    @F.pandas_udf("forest_rank double, deviation double, score double")
    def read_all(*columns: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        whole, out = ~np.isnan(x).any(axis=1), np.full((len(x), 3), np.nan)
        if whole.any():
            rank, deviation = shared.value.readings(x[whole])
            score = np.searchsorted(shared.value.combined, np.maximum(rank, deviation), "right") / len(shared.value.rows)
            out[whole] = np.column_stack([rank, deviation, score])
        return pd.DataFrame(out, columns=["forest_rank", "deviation", "score"]).astype(object).where(~np.isnan(out), None)

    df = df.withColumn("_read", read_all(*[F.col(n).cast("double") for n in reference.names]))
    return df.select("*", "_read.*").drop("_read")


def drift_by_rank(recorded: DataFrame, computed: DataFrame, score: str) -> DataFrame:
    """One row (n_recorded, n_computed, drift): the largest gap between scores of equal rank; null if the numbers differ.

    Ranks come from ranges of the scores, so neither side has to fit into one task.
    """
    placed = lambda df, name: ranked(df.where(F.col(score).isNotNull()).select(F.col(score).alias(name)), name, "_i")
    both = placed(recorded, "_a").join(placed(computed, "_b"), "_i", "full")
    out = both.agg(F.count("_a").alias("n_recorded"), F.count("_b").alias("n_computed"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("_gap"))
    return out.withColumn("drift", F.when(F.col("n_recorded") == F.col("n_computed"), F.col("_gap"))).drop("_gap")
