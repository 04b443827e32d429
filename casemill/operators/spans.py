"""Spans [start, end) within a key: merging, the strongest of a group, containment and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_groups(spans: DataFrame, key: str, *tie: str) -> DataFrame:
    """Adds ``span_group``: spans that overlap, directly or over others; touching ones do not."""
    order = W.partitionBy(key).orderBy("start", F.col("end").desc(), *tie)
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") < reach, 0).otherwise(1)
    return spans.withColumn("_fresh", fresh).withColumn("span_group", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")


def merged(spans: DataFrame, key: str, *tie: str) -> DataFrame:
    return overlap_groups(spans, key, *tie).groupBy(key, "span_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def strongest(spans: DataFrame, key: str, evidence: str, kind: str) -> DataFrame:
    """One span of each group: most evidence, then longest, then first, then by kind."""
    rank = F.struct(F.col(evidence), (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), F.col(kind))
    best = F.max_by(F.struct("start", "end", kind), rank)
    return overlap_groups(spans, key, kind).groupBy(key, "span_group").agg(best.alias("b")).select(key, "span_group", "b.*")


def contained(labels: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Labels that one found span of the same kind covers; the key makes it an equi-join."""
    f = found.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col(key) == F.col("_k")) & (F.col("kind") == F.col("_kind")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end"))
    return labels.join(f, on, "left_semi")


def overlapping(found: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Found spans that overlap a label of the same kind."""
    x = labels.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col(key) == F.col("_k")) & (F.col("kind") == F.col("_kind")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return found.join(x, on, "left_semi")


def recall_by_kind(labels: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(kind, n_labels, n_found, n_hits, n_right, recall, precision, passed): a label counts if one hit of its kind covers it,
    a hit is right if it overlaps a label of its kind; kinds without labels or hits have share 1, and pass if all labels are found."""
    n = lambda df, name: df.groupBy("kind").agg(F.count("*").alias(name))
    both = n(labels, "n_labels").join(n(contained(labels, found, key), "n_found"), "kind", "left").join(n(found, "n_hits"), "kind", "full").join(n(overlapping(found, labels, key), "n_right"), "kind", "left")
    out = both.select("kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_labels", "n_found", "n_hits", "n_right")])
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    return out.withColumns({"recall": share("n_found", "n_labels"), "precision": share("n_right", "n_hits"), "passed": F.col("n_found") == F.col("n_labels")})
