"""Offsets of regular-expression matches, and spans that keep apart from others, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.arrays import running_max
from casemill.functions.text import MARK, OTHER, match_spans, pieces

__all__ = ["MARK", "OTHER", "matches", "pieces", "with_apart"]

#: More than any offset.
FAR = (1 << 31) - 1


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, value string>> of the matches, in order; a pattern can't match the control characters 1 and 2."""
    return match_spans(text, pattern)


def with_apart(df: DataFrame, spans: str, others: str, out: str) -> DataFrame:
    """Adds ``out``: those of ``spans`` (start, end, value; sorted, none overlaps another) that overlap none of ``others`` (start, end).

    Both are put into one order, in which the furthest end so far and the nearest start from here on tell for each span whether
    another one reaches it; no span is compared with all others.
    """
    one = lambda x, own, value: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), value.alias("value"))
    mixed = F.sort_array(F.concat(F.transform(others, lambda x: one(x, False, F.lit(""))), F.transform(spans, lambda x: one(x, True, x["value"]))))
    df = df.withColumn(out, mixed)
    df = df.withColumn(out + "_reach", running_max(F.transform(out, lambda x: F.when(x["own"], 0).otherwise(x["end"]))))
    df = df.withColumn(out + "_next", F.reverse(running_max(F.transform(F.reverse(out), lambda x: F.when(x["own"], 0).otherwise(F.lit(FAR) - x["start"])))))
    free = lambda x, i: x["own"] & (F.get(out + "_reach", i) <= x["start"]) & (F.lit(FAR) - F.get(out + "_next", i) >= x["end"])
    kept = F.transform(out, lambda x, i: F.when(free(x, i), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
    return df.withColumn(out, F.filter(kept, lambda x: x.isNotNull())).drop(out + "_reach", out + "_next")
