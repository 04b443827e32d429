"""Review actions as appends: confirm, override and escalate are accepted or refused, never edit anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.text import is_blank

OVERRIDABLE = ("unit", "tier")


def refusal(action: Column, field: Column, reason: Column, new: Column, current: Column, tier: Column, confirmed: Column) -> Column:
    """Why an action is refused, or null: confirmed already, unknown field, no reason, no change, already at the top tier."""
    blank = is_blank(reason)
    return (
        F.when(confirmed, "already_confirmed")
        .when((action == "override") & ~F.coalesce(field.isin(*OVERRIDABLE), F.lit(False)), "unknown_field")
        .when(action.isin("override", "escalate") & blank, "no_reason")
        .when((action == "override") & new.eqNullSafe(current), "no_change")
        .when((action == "escalate") & (tier >= 3), "already_highest")
    )


def judged(actions: DataFrame, cases: DataFrame, case: str, *order: str) -> DataFrame:
    """Actions (action, field, reason, new) with their ``refusal``; cases carry unit, tier and confirmed.

    An action after a confirmation of the same case in the batch is refused too.
    """
    before = W.partitionBy(case).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = actions.join(cases.select(case, F.col("unit").alias("_unit"), F.col("tier").alias("_tier"), F.col("confirmed").alias("_confirmed")), case, "left")
    earlier = F.coalesce(F.max((F.col("action") == "confirm").cast("int")).over(before), F.lit(0)) == 1
    current = F.when(F.col("field") == "unit", F.col("_unit").cast("string")).otherwise(F.col("_tier").cast("string"))
    joined = joined.withColumn("_done", earlier | F.coalesce("_confirmed", F.lit(False)))
    why = refusal(F.col("action"), F.col("field"), F.col("reason"), F.col("new").cast("string"), current, F.coalesce("_tier", F.lit(0)), F.col("_done"))
    return joined.withColumn("refusal", why).drop("_unit", "_tier", "_confirmed", "_done")
