"""A case from submission to decision in one plan, every stage journaled.

The stages have a fixed order: received, sealed (payload by identity path, text by the recognizers), text layer, derivation
and extraction, evidence (routing and completeness), score, decision.  Each is a set of columns over the row of its case, so
a run needs no join and no shuffle.  A stage that fails for a case writes its name into ``error``; the stages after it leave
the case alone, and the decision gives it full review.  A failure never ends the job.

Each stage appends one event to the row; :func:`journal_rows` numbers them and names each by case and number, and
:func:`append_journal` adds what a journal lacks, so that a repeated run adds nothing.  Events and results hold no raw value:
raw payload and text are dropped with the stage that seals them.

Cases: a payload that is no JSON object fails as "payload"; a text that the boundary rejects fails as "boundary"; no payload
is an empty one; a submission without text has none and goes on; a scorer without a score for a case is journaled as
degraded, and the case goes on without one; a null submission id is a case of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.arrays import settled
from casemill.functions.paths import json_path
from casemill.functions.text import PLACEHOLDER, normal_text
from casemill.plans import decisions
from casemill.sources import stores
from casemill.sources.submissions import part_list

from . import boundary, decide, evidence
from .context import IdentityField

EVENTS = "array<struct<type:string,detail:string>>"


@dataclass(frozen=True)
class Plan:
    #: Field -> (dotted path in the payload, type).
    fields: Mapping[str, tuple[str, str]]
    signals: Mapping[str, Mapping[str, Any]]
    routes: Sequence[evidence.Route]
    #: Requirements by procedure; other procedures can't be evaluated.
    requirements: Mapping[str, Sequence[evidence.Requirement]]
    table: Sequence[decisions.Row]
    downgrades: Sequence[decisions.Downgrade] = ()
    identity: Sequence[IdentityField] = ()
    clear_cut: Mapping[str, Any] | None = None
    tier1_procedures: Sequence[str] = ()
    scorer: Callable[[DataFrame], Column] | None = None
    flag_from: float = 1.0
    enforcing: bool = True
    salt: str = ""
    audit_rate: float = 0.0
    versions: Mapping[str, str] = field(default_factory=dict)


def _event(df: DataFrame, kind: Column | str, detail: Mapping[str, Column], when: Column) -> DataFrame:
    """Appends one event where ``when`` holds."""
    one = F.array(F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.to_json(F.struct(*[c.alias(k) for k, c in detail.items()])).alias("detail")))
    return df.withColumn("events", F.when(when, F.concat("events", one)).otherwise(F.col("events")))


def _failed(df: DataFrame, stage: str, wrong: Column) -> DataFrame:
    """Marks cases that go wrong here and went well before; the event says where."""
    here = F.col("error").isNull() & F.coalesce(wrong, F.lit(True))
    df = _event(df, "STAGE_FAILED", {"stage": F.lit(stage)}, here)
    return df.withColumn("error", settled(F.when(here, F.lit(stage)).otherwise(F.col("error"))))


def _received(submissions: DataFrame) -> DataFrame:
    df = submissions.select(
        F.concat(F.lit("case-"), F.coalesce("submissionId", F.lit(""))).alias("case_id"), F.col("submittedAt").alias("created_at"), "channel", F.col("procedureHint").alias("hint"),
        F.coalesce("data", F.lit("{}")).alias("_payload"), part_list().alias("_parts"), F.lit(None).cast("string").alias("error"), F.expr(f"cast(array() as {EVENTS})").alias("events"),
    )
    df = _event(df, "RECEIVED", {"channel": F.col("channel"), "n_parts": F.size("_parts")}, F.lit(True))
    whole = F.try_parse_json("_payload").isNotNull() & F.coalesce(F.schema_of_variant(F.try_parse_json("_payload")).startswith("OBJECT"), F.lit(False))
    return _failed(df, "payload", ~whole)


def _sealed(df: DataFrame, plan: Plan) -> DataFrame:
    ok = F.col("error").isNull()
    df = df.withColumn("_payload", F.when(ok, F.col("_payload")))
    if plan.identity:
        df = boundary.sealed_payload(df, "case_id", "_payload", plan.identity, plan.salt).drop("_payload")
    else:
        df = df.withColumnRenamed("_payload", "sealed_payload").withColumn("payload_entries", F.expr("cast(array() as array<struct<path:string,kind:string,value:string,token:string>>)"))
    df = df.withColumn("source_types", F.array_sort(F.array_distinct(F.transform("_parts", lambda p: p["source_type"]))))
    df = df.withColumn("_told", F.when(ok, normal_text(F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")))).drop("_parts")
    df = boundary.passed(df, "case_id", "_told", plan.salt).drop("_told").withColumnsRenamed({"sealed_text": "text_normalized", "entries": "text_entries", "outcome": "_outcome"})
    df = _event(df, "SEALED", {"n_payload": F.size("payload_entries"), "n_text": F.size("text_entries"), "outcome": F.col("_outcome")}, ok & (F.col("_outcome") != "rejected"))
    df = _failed(df, "boundary", F.col("_outcome") == "rejected").drop("_outcome")
    return _event(df, "TEXT_LAYER", {"n_chars": F.coalesce(F.length("text_normalized"), F.lit(0)), "source_types": F.col("source_types")}, F.col("error").isNull())


def _extracted(df: DataFrame, plan: Plan) -> DataFrame:
    ok = F.col("error").isNull()
    for name, (path, kind) in plan.fields.items():
        df = df.withColumn(name, F.when(ok, json_path(F.col("sealed_payload"), path)).try_cast(kind))
    df = evidence.derive(df, F.col("hint"), plan.signals)
    found = F.size(F.filter(F.array(*[F.col(n).isNotNull() for n in plan.fields]), lambda x: x))
    return _event(df, "EXTRACTED", {"n_fields": found, "procedure": F.col("derived"), "derivation": F.col("derivation")}, ok)


def _evidence(df: DataFrame, plan: Plan) -> DataFrame:
    ok = F.col("error").isNull()
    df = decide.minima(decide.suggestions(evidence.route(df, plan.routes)))
    none = F.expr("cast(array() as array<struct<requirement_id:string,status:string,failed:string>>)")
    gaps, verdict = none, F.lit("NOT_EVALUABLE")
    for i, (procedure, requirements) in enumerate(plan.requirements.items()):
        df = evidence.completeness(df, requirements).withColumnsRenamed({"gaps": f"_gaps{i}", "verdict": f"_verdict{i}"})
        here = F.col("derived") == procedure
        gaps, verdict = F.when(here, F.col(f"_gaps{i}")).otherwise(gaps), F.when(here, F.col(f"_verdict{i}")).otherwise(verdict)
    df = df.withColumns({"gaps": settled(gaps), "verdict": settled(verdict)}).drop(*[f"_{n}{i}" for i in range(len(plan.requirements)) for n in ("gaps", "verdict")])
    df = decide.clear_cut(df, plan.clear_cut)
    detail = {"units": F.transform("units", lambda u: u["unit"]), "confidence": F.col("routing_confidence"), "verdict": F.col("verdict"), "gaps": F.transform("gaps", lambda g: g["requirement_id"]), "clear_cut": F.col("clear_cut")}
    return _event(df, "EVIDENCE", detail, ok)


def _scored(df: DataFrame, plan: Plan) -> DataFrame:
    ok = F.col("error").isNull()
    score = F.when(ok, plan.scorer(df)) if plan.scorer else F.lit(None)
    df = df.withColumn("score", score.cast("double")).withColumn("flagged", F.coalesce(F.col("score") >= plan.flag_from, F.lit(False)))
    if not plan.scorer:
        return df
    kind = F.when(F.col("score").isNull(), "SCORE_DEGRADED").otherwise("SCORED")
    return _event(df, kind, {"flagged": F.col("flagged")}, ok)


def _decided(df: DataFrame, plan: Plan) -> DataFrame:
    df = df.withColumns({
        "gap_count": F.size("gaps"), "min_confidence": F.lit(1.0), "discarded_count": F.lit(0), "tier1_enabled": F.coalesce(F.col("derived").isin(*plan.tier1_procedures), F.lit(False)),
    })
    df = decide.decide(df, plan.table, plan.downgrades, key="case_id", enforcing=plan.enforcing, audit_rate=plan.audit_rate, audit_salt=plan.salt, failed=F.col("error").isNotNull())
    detail = {"tier": F.col("tier"), "unit": F.col("routed_unit"), "reasons": F.transform("reasons", lambda r: r["rule_id"]), "versions": F.struct(*[F.lit(v).alias(k) for k, v in sorted({"plan": "1", **plan.versions}.items())])}
    return _event(df, "DECIDED", detail, F.lit(True))


RESULT = ("case_id", "created_at", "error", "derived", "derivation", "routed_unit", "verdict", "gaps", "score", "flagged", "pre_tier", "tier", "row_id", "sampled", "reasons", "sealed_payload", "text_normalized", "events")


def run_cases(submissions: DataFrame, plan: Plan) -> DataFrame:
    """One row for each submission, with the columns of ``RESULT``; the vault's entries are columns of :func:`entries`."""
    return _run(submissions, plan).select(*RESULT)


def _run(submissions: DataFrame, plan: Plan) -> DataFrame:
    return _decided(_scored(_evidence(_extracted(_sealed(_received(submissions), plan), plan), plan), plan), plan)


def entries(submissions: DataFrame, plan: Plan) -> DataFrame:
    """(case_id, kind, value, token): the vault of a run, to be kept apart from its results."""
    kept = lambda c: F.transform(c, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), e["token"].alias("token")))
    df = _sealed(_received(submissions), plan).where(F.col("error").isNull())
    return df.select("case_id", F.explode(F.concat(kept("payload_entries"), F.coalesce(kept("text_entries"), F.expr("cast(array() as array<struct<kind:string,value:string,token:string>>)")))).alias("e")).select("case_id", "e.*")


def journal_rows(cases: DataFrame, held: Column | None = None) -> DataFrame:
    """(case_id, sequence, type, detail, occurred_at, event_id) of every stage; the same for each run over the same cases.

    Sequences in ``held``, an array, are left out before anything else is made of them.
    """
    rows = cases.select("case_id", F.col("created_at").alias("occurred_at"), F.posexplode("events").alias("_i", "e"), *([held.alias("_held")] if held is not None else []))
    rows = rows.where(~F.coalesce(F.array_contains("_held", F.col("_i").cast("long")), F.lit(False))) if held is not None else rows
    return rows.select(
        "case_id", F.col("_i").cast("long").alias("sequence"), "e.type", "e.detail", "occurred_at", F.substring(F.sha2(F.concat_ws("|", "case_id", F.col("_i").cast("string")), 256), 1, 32).alias("event_id")
    )


def append_journal(cases: DataFrame, path: str) -> int:
    """Appends the events that the journal lacks; returns their number.

    An event id is made of case and sequence, so cases meet the journal as rows with all of their events; of rows with the same
    case, the one with most events counts.
    """
    most = F.max_by(F.struct("created_at", "events"), F.size("events"))
    once = cases.groupBy("case_id").agg(most.alias("_case")).select("case_id", "_case.*")
    stored = stores.stored_like(journal_rows(cases), path, "event_id")
    if stored is None:
        return stores.append_counted(journal_rows(once), path, "event_id")
    held = stored.groupBy(F.col("case_id").alias("_id")).agg(F.collect_set("sequence").alias("_sequences"))
    return stores.append_counted(journal_rows(once.join(held, F.col("case_id").eqNullSafe(F.col("_id")), "left"), F.col("_sequences")), path, "event_id")


def holds_raw(cases: DataFrame, values: Column) -> Column:
    """Whether a result's texts or events hold one of the raw values (an array): they never should."""
    texts = F.concat_ws("\n", "sealed_payload", "text_normalized", F.to_json("events"))
    return F.exists(values, lambda v: F.contains(F.regexp_replace(texts, PLACEHOLDER, ""), v))
