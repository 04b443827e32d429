"""How much of labelled personal data the recognizers find: the labelled set as a source, recall by kind, and its gate.

A label is found if one span of its kind covers it whole.  A span is right if it overlaps a label of its kind.  Kinds that
are gated must be found whole; the others are reported only.

Cases: a set without items, labels outside their text and empty labels are refused; texts without labels count for precision;
a kind without labels or without spans has share 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import recognizers
from casemill.session import stored

from . import spans

LABELLED = "item_id string, text string, labels array<struct<kind:string,start:int,end:int>>"


def write_labelled(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path, ignoreNullFields=False)


def labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, text, labels) from JSON lines; lines that are none of that fail the read."""
    return checked(spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path))


def checked(items: DataFrame) -> DataFrame:
    wrong = F.exists("labels", lambda x: ~F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("text")), F.lit(False)))
    n, outside = items.agg(F.count("*"), F.count_if(F.coalesce(wrong, F.lit(True)))).first()
    if not n:
        raise ValueError("the labelled set has no item")
    if outside:
        raise ValueError(f"{outside} items have labels outside their text")
    return items


def measured(items: DataFrame, gated: Sequence[str], profile: str = recognizers.REDACT) -> DataFrame:
    """(kind, n_labels, n_found, n_hits, n_right, recall, precision, gated, passed): the recognizers on the texts of a labelled set."""
    labels = items.select("item_id", F.explode("labels").alias("l")).select("item_id", "l.kind", "l.start", "l.end")
    hits = recognizers.spans(items.select("item_id", "text"), "text", "found", profile)
    hits = stored(hits.select("item_id", F.explode("found").alias("s")).select("item_id", "s.kind", "s.start", "s.end"), "hits")  # read three times, found once
    report = spans.recall_by_kind(labels, hits, "item_id").drop("passed")
    return report.withColumn("gated", F.col("kind").isin(*gated)).withColumn("passed", ~F.col("gated") | (F.col("n_found") == F.col("n_labels")))


def overall(report: DataFrame) -> DataFrame:
    """One row over the gated kinds: labels, found, recall, and whether every gated kind passes."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("gated"), F.col(c))), F.lit(0))
    sums = report.agg(n("n_labels").alias("n_labels"), n("n_found").alias("n_found"), F.coalesce(F.min("passed"), F.lit(True)).alias("passed"))
    return sums.withColumn("recall", F.when(F.col("n_labels") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_labels")))
