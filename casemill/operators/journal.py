"""The append-only event journal: sequence, validation, folds, owed work, latencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequenced(events: DataFrame, case: str, *order: str) -> DataFrame:
    """Adds ``sequence``, from 0 for each case, and ``event_count``."""
    by = W.partitionBy(case).orderBy(*order)
    return events.withColumn("sequence", F.row_number().over(by).cast("long") - 1)


def violations(journal: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases whose sequence has gaps or repeats, or whose event ids repeat."""
    by = journal.groupBy(case).agg(
        F.count("*").alias("n"), F.countDistinct("sequence").alias("n_sequences"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.countDistinct("event_id").alias("n_ids")
    )
    return by.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("n_sequences") != F.col("n")) | (F.col("n_ids") != F.col("n")))


def folded(journal: DataFrame, case: str, latest: Mapping[str, tuple[Column, Column]], order: Sequence[str]) -> DataFrame:
    """State of each case: for each name the value of the last event for which the condition holds."""
    key = F.struct(*order)
    return journal.groupBy(case).agg(*[F.max_by(value, F.when(condition, key)).alias(name) for name, (condition, value) in latest.items()])


def effective(journal: DataFrame, case: str, order: Sequence[str], *, decided: Column, machine_unit: Column, machine_tier: Column, field: Column, to_unit: Column, to_tier: Column) -> DataFrame:
    """The machine's last unit and tier, changed by overrides in order: (case, unit, tier, escalated).

    ``field`` is "unit", "tier", "escalation" or anything else that changes nothing.  The last override of the unit holds,
    also if it clears the unit; a tier that is no number is left out; an escalation moves the tier like an override of it,
    and a case that was escalated once stays so.
    """
    key = F.struct(*order)
    to_other_tier = field.isin("tier", "escalation") & to_tier.isNotNull()
    folded = journal.groupBy(case).agg(
        F.max_by(F.struct(machine_unit.alias("unit"), machine_tier.alias("tier")), F.when(decided, key)).alias("_machine"),
        F.max_by(F.struct(to_unit.alias("unit")), F.when(field == "unit", key)).alias("_unit"),
        F.max_by(to_tier, F.when(to_other_tier, key)).alias("_tier"),
        F.coalesce(F.bool_or(field == "escalation"), F.lit(False)).alias("escalated"),
    )
    return folded.select(
        case,
        F.when(F.col("_unit").isNotNull(), F.col("_unit.unit")).otherwise(F.col("_machine.unit")).alias("unit"),
        F.coalesce("_tier", "_machine.tier").alias("tier"),
        "escalated",
    )


def owed(sources: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    """Events for which nothing has been done yet: an anti-join on the source event."""
    return sources.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def next_event(events: DataFrame, case: str, order: Sequence[str], *, is_start: Column, is_end: Column, at: str) -> DataFrame:
    """Each start with the time of the next end of its case, found in one pass by a window; null if there is none."""
    after = W.partitionBy(case).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    found = events.withColumn("end_at", F.min(F.when(is_end, F.col(at))).over(after))
    return found.where(is_start)


def notified_pairs(events: DataFrame, case: str, *, notified: Column, event_id: str, source_id: str, kind: str, at: str) -> DataFrame:
    """(case, event_id, trigger, sent_at, source_at): each notification with the event of its case that it names.

    Notifications whose source is not among the events of the case are left out.
    """
    sources = events.select(F.col(case).alias("_case"), F.col(event_id).alias("_id"), F.col(kind).alias("trigger"), F.col(at).alias("source_at"))
    sent = events.where(notified & F.col(source_id).isNotNull()).select(case, event_id, source_id, F.col(at).alias("sent_at"))
    return sent.join(sources, (F.col(case) == F.col("_case")) & (F.col(source_id) == F.col("_id"))).select(case, event_id, "trigger", "sent_at", "source_at")


def nearest_rank(values: str, share: float) -> Column:
    """The whole-numbered value at rank ceil(share * n), as ``percentile_disc`` defines it."""
    return F.expr(f"percentile_disc({share}) within group (order by {values})").cast("long")


def latency_summary(pairs: DataFrame, seconds: str, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(seconds).alias("low"), nearest_rank(seconds, 0.5).alias("p50"), nearest_rank(seconds, 0.95).alias("p95"), F.max(seconds).alias("high")
    )


def listed(journal: DataFrame, case: str, condition: Column, value: Column, order: Sequence[str]) -> Column:
    """An aggregate: the values of a case's events for which the condition holds, in order."""
    kept = F.collect_list(F.when(condition, F.struct(*order, value.alias("_value"))))
    return F.transform(F.array_sort(kept), lambda x: x["_value"])


def corrections(overrides: DataFrame, state: DataFrame, case: str, at: str, event_id: str) -> DataFrame:
    """Corrections with the machine's state of their case, and their ``place`` by case, time and id.

    Cases are counted first; a case starts after all cases before it, so no task orders more than the corrections of one case.
    """
    from .ranks import running

    counts = overrides.where(F.col(case).isNotNull()).groupBy(case).agg(F.count("*").alias("_n"))
    starts = running(counts, case, "_n", "_upto").select(case, (F.col("_upto") - F.col("_n")).alias("_start"))
    inside = F.row_number().over(W.partitionBy(case).orderBy(at, event_id))
    joined = overrides.withColumn("_inside", inside).join(starts, case).join(state, case)
    return joined.withColumn("place", (F.col("_start") + F.col("_inside")).cast("long")).drop("_inside", "_start")
