"""Drafts and messages: policy, gap sentences, letters (whole or nothing), notifications."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.dates import delivery_date, next_working_day, shifted_days
from casemill.functions.text import PLACEHOLDER, is_blank, rendered


def draft_kind(tier: Column, n_gaps: Column) -> Column:
    """Tier 1: a prepared decision; tier 2 with gaps: a request; else none."""
    return F.when(tier == 1, "decision").when((tier == 2) & (n_gaps > 0), "request")


def gap_sentences(gaps: Column, templates: Mapping[str, str], default: str = "{requirement_id}: {status}") -> Column:
    """One sentence for each gap: its status' template, or the default."""

    def one(g: Column) -> Column:
        values = {"requirement_id": g["requirement_id"], "status": g["status"], "failed": g["failed"]}
        out = rendered(default, values)
        for status, template in templates.items():
            out = F.when(g["status"] == status, rendered(template, values)).otherwise(out)
        return out

    return F.transform(gaps, one)


def letters(df: DataFrame, template: str, declared: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Adds ``letter`` and ``blocked``: a declared value that is missing or blank blocks the whole letter.

    The values given must be exactly the declared ones.
    """
    if set(declared) != set(values):
        raise ValueError(f"keys differ: {sorted(set(declared) ^ set(values))}")
    missing = F.filter(F.array(*[F.when(is_blank(values[k].cast("string")), F.lit(k)) for k in declared]), lambda x: x.isNotNull())
    df = df.withColumn("blocked", missing)
    return df.withColumn("letter", F.when(F.size("blocked") == 0, rendered(template, values)))


def notifications(events: DataFrame, done: DataFrame, templates: Mapping[str, str], values: Mapping[str, Column]) -> DataFrame:
    """Owed messages: events with a template that were not notified yet; a rendered placeholder is refused (null text)."""
    for template in templates.values():
        if unknown := set(re.findall(r"\{(\w+)\}", template)) - set(values):
            raise ValueError(f"a message names unknown values: {sorted(unknown)}")
    known = events.where(F.col("type").isin(*templates)).join(done.select(F.col("source_event_id").alias("event_id")), "event_id", "left_anti")
    out = F.lit(None).cast("string")
    for kind, template in templates.items():
        out = F.when(F.col("type") == kind, rendered(template, values)).otherwise(out)
    known = known.withColumn("_text", out)
    return known.withColumn("message", F.when(~F.col("_text").rlike(PLACEHOLDER), F.col("_text"))).drop("_text")


def chunks(text: Column, size: int) -> Column:
    """array<struct<start, chunk>> of consecutive parts; empty for empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * size)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("chunk")))


def drafts(df: DataFrame, kinds: Mapping[str, tuple[str, Sequence[str]]], values: Mapping[str, Column]) -> DataFrame:
    """Adds ``blocked`` and ``letter`` by the column ``kind``: each kind has a template and the values that it declares.

    A declared value that is missing or blank blocks the whole letter; a kind that is not among them has neither.
    """
    blocked, letter = F.array().cast("array<string>"), F.lit(None).cast("string")
    for kind, (template, declared) in kinds.items():
        missing = F.filter(F.array(*[F.when(is_blank(values[k].cast("string")), F.lit(k)) for k in declared]), lambda x: x.isNotNull())
        blocked = F.when(F.col("kind") == kind, missing).otherwise(blocked)
        letter = F.when(F.col("kind") == kind, rendered(template, {k: values[k] for k in declared})).otherwise(letter)
    df = df.withColumn("blocked", blocked)
    return df.withColumn("letter", F.when(F.size("blocked") == 0, letter))


def softened(gaps: Column, optional: Sequence[str]) -> Column:
    """Gaps with ``softened``: whether the requirement is one that a letter asks for only in passing."""
    return F.transform(gaps, lambda g: g.withField("softened", F.coalesce(g["requirement_id"].isin(*optional), F.lit(False)) if optional else F.lit(False)))


def dispatch_facts(cases: DataFrame, sent: Column, window_days: int, holidays: Sequence[str] = ()) -> DataFrame:
    """Adds delivered, deadline and the days that both were shifted by, for request letters only; the text is not part of it."""
    is_request = F.col("kind") == "request"
    raw = F.date_add(sent, 4)
    df = cases.withColumn("delivered", F.when(is_request, delivery_date(sent, holidays)))
    df = df.withColumn("deadline", F.when(is_request, next_working_day(F.date_add(F.col("delivered"), window_days), holidays)))
    shifts = F.concat(shifted_days(raw, holidays), shifted_days(F.date_add(F.col("delivered"), window_days), holidays))
    return df.withColumn("shifted", F.when(is_request, shifts))


def gap_message(gap: Column, values: Mapping[str, Column], hidden: Sequence[str] = ()) -> Column:
    """What is wrong with a value, quoting it unless its field is sealed."""
    out = F.lit(None).cast("string")
    for name, value in values.items():
        shown = F.lit("") if name in hidden else F.concat(F.lit(" "), F.coalesce(value.cast("string"), F.lit("")))
        out = F.when(gap["requirement_id"] == name, F.concat(F.lit(name), shown, F.lit(" failed "), gap["failed"])).otherwise(out)
    return out
