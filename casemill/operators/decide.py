"""The decision of one case, chained: admitted evidence, first matching row, downgrades, audit sample, error rail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.plans import decisions
from casemill.plans.rules import RuleError, compile_rule

#: The only fields that a row of the table may test; nothing of the anomaly score is among them.
QUALIFYING = ("routing_confidence", "rule_hit", "verdict", "gap_count", "min_confidence", "discarded_count", "tier1_enabled", "clear_cut")
SUGGESTIONS = "array<struct<unit:string,source:string,confidence:double,rule_ids:array<string>>>"


def check_table(table: Sequence[decisions.Row]) -> None:
    """Every field that a row tests must be a qualifying one."""

    def fields(rule: Mapping[str, Any]):  # noqa: ANN202
        if "field" in rule:
            yield rule["field"]
        for part in rule.get("all", []) + rule.get("any", []):
            yield from fields(part)

    for row in table:
        for name in fields(row.when):
            if name not in QUALIFYING:
                raise RuleError(f"row {row.row_id}: {name} may not qualify a decision")


def suggestions(df: DataFrame, units: str = "units") -> DataFrame:
    """Adds ``routing``: a suggestion for each unit of :func:`casemill.operators.evidence.route`.

    The winner has the confidence of the case, all others 0.5.
    """
    each = F.transform(units, lambda u, i: F.struct(u["unit"].alias("unit"), F.lit("rule").alias("source"), F.when(i == 0, F.col("confidence")).otherwise(F.lit(0.5)).alias("confidence"), F.array(u["rule_id"]).alias("rule_ids")))
    return df.withColumn("routing", each.cast(SUGGESTIONS))


def with_fallback(df: DataFrame, unit: Column, score: Column, *, calibrated: bool, least: float = 0.0) -> DataFrame:
    """Adds a classifier's suggestion to ``routing`` where no rule fired; uncalibrated ones have confidence 0, and only calibrated
    ones can be below ``least``, which leaves them out.  A null unit (also of a failed classifier) suggests nothing."""
    confidence = score if calibrated else F.lit(0.0)
    keep = unit.isNotNull() & (F.coalesce(score >= least, F.lit(False)) if calibrated else F.lit(True))
    one = F.array(F.struct(unit.alias("unit"), F.lit("classifier").alias("source"), confidence.cast("double").alias("confidence"), F.array().cast("array<string>").alias("rule_ids")))
    none = F.expr(f"cast(array() as {SUGGESTIONS})")
    return df.withColumn("routing", F.when(F.size("routing") > 0, F.col("routing")).otherwise(F.when(keep, one.cast(SUGGESTIONS)).otherwise(none)))


def admitted(routing: str, sources: Sequence[str]) -> Column:
    return F.filter(routing, lambda s: s["source"].isin(*sources))


def minima(df: DataFrame, sources: Sequence[str] = ("rule",), routing: str = "routing") -> DataFrame:
    """Adds routing_confidence (0 for none), rule_hit and routed_unit: of the highest confidence, the first."""
    kept = admitted(routing, sources)
    best = F.array_max(F.transform(kept, lambda s, i: F.struct(s["confidence"].alias("confidence"), (-i).alias("place"), s["unit"].alias("unit"))))
    return df.withColumns({"routing_confidence": F.coalesce(best["confidence"], F.lit(0.0)), "rule_hit": F.exists(kept, lambda s: s["source"] == "rule"), "routed_unit": best["unit"]})


def clear_cut(df: DataFrame, criteria: Mapping[str, Any] | None) -> DataFrame:
    """Adds ``clear_cut``; without criteria nothing is."""
    return df.withColumn("clear_cut", compile_rule(criteria, df.schema) if criteria else F.lit(False))


def decide(
    df: DataFrame, table: Sequence[decisions.Row], downgrades: Sequence[decisions.Downgrade], *, key: str, enforcing: bool, audit_rate: float = 0.0, audit_salt: str = "", failed: Column | None = None
) -> DataFrame:
    """Adds pre_tier, tier, row_id, n_failed, fired, sampled and reasons; the columns of ``QUALIFYING``, score and flagged must be there.

    ``reasons`` are structs of kind and rule id in the order in which they came.  Where ``failed`` holds, the case has tier 3, no unit
    and the one reason "error": a failure means full review, never a failed job.
    """
    check_table(table)
    out = decisions.decide(df, table, "pre_tier", "row_id", "n_failed")
    out = decisions.downgrade(out, downgrades, "pre_tier", enforcing=enforcing)
    out = decisions.audit_sample(out.withColumnRenamed("final_tier", "tier"), key, audit_rate, audit_salt, "tier")
    reason = lambda kind, rule: F.struct(F.lit(kind).alias("kind"), rule.alias("rule_id"))
    ids = F.array(*[F.lit(r.row_id) for r in table])
    none = F.expr("cast(array() as array<struct<kind:string,rule_id:string>>)")
    reasons = F.concat(
        F.transform(F.slice(ids, F.lit(1), F.col("n_failed").cast("int")), lambda r: reason("row_failed", r)),
        F.array(F.when(F.col("row_id") == "default", reason("default", F.lit("default"))).otherwise(reason("row_matched", F.col("row_id")))),
        F.transform("fired", lambda r: reason("downgraded", r)) if enforcing else none,
        F.when(F.col("sampled"), F.array(reason("sampled", F.lit("audit_sample")))).otherwise(none),
    )
    out = out.withColumn("reasons", reasons)
    if failed is not None:
        wrong = F.coalesce(failed, F.lit(True))
        full = F.lit(decisions.DEFAULT_TIER)
        out = out.withColumns(
            {
                "pre_tier": F.when(wrong, full).otherwise(F.col("pre_tier")), "tier": F.when(wrong, full).otherwise(F.col("tier")), "sampled": ~wrong & F.col("sampled"),
                "routed_unit": F.when(~wrong, F.col("routed_unit")), "reasons": F.when(wrong, F.array(reason("error", F.lit("error")))).otherwise(F.col("reasons")),
            }
        )
    return out


def was_sampled(reasons: Column) -> Column:
    """Whether a recorded decision was drawn for audit, in either form that was ever written."""
    return F.coalesce(F.exists(reasons, lambda r: (r["kind"] == "sampled") | ((r["kind"] == "downgraded") & (r["rule_id"] == "audit_sample"))), F.lit(False))


def queue_flags(df: DataFrame, *, age_hours: Column, budget_hours: Mapping[int, float], objection_unit: str, objection_hours: float, clearing_hours: float) -> Column:
    """Names of what a reviewer should see first, in a fixed order; ``df`` has sampled, flagged, escalated, unit and tier."""
    budget = F.element_at(F.create_map(*[x for k, v in budget_hours.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("tier"))
    tests = {
        "sampled": F.col("sampled"), "anomaly": F.col("flagged"), "escalated": F.col("escalated"), "objection": F.col("unit") == objection_unit,
        "objection_late": (F.col("unit") == objection_unit) & (age_hours > objection_hours), "clearing_late": F.col("unit").isNull() & (age_hours > clearing_hours), "over_budget": age_hours > budget,
    }
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
