"""The run from submission to decision: error rail, journal appended once, nothing raw in results."""

import json

from pyspark.sql import functions as F

from casemill.operators import context, evidence, run
from casemill.plans import decisions
from casemill.sources import submissions

PLAN = run.Plan(
    fields={"kind": ("request.kind", "string"), "sum": ("request.sum", "double"), "name": ("person.name", "string")},
    signals={"grant": {"field": "kind", "op": "eq", "value": "grant"}},
    routes=(evidence.Route("r1", "north", 10, {"field": "kind", "op": "eq", "value": "grant"}), evidence.Route("r2", "south", 20, {"field": "text_normalized", "op": "contains", "value": "hurry"})),
    requirements={"grant": (evidence.Requirement("named", "name"), evidence.Requirement("summed", "sum"))},
    table=(decisions.Row("clear", {"all": [{"field": "verdict", "op": "eq", "value": "COMPLETE"}, {"field": "clear_cut", "op": "eq", "value": True}]}, 1), decisions.Row("routed", {"field": "rule_hit", "op": "eq", "value": True}, 2)),
    identity=(context.IdentityField("person.name", "NAME"),), clear_cut={"field": "sum", "op": "lt", "value": 100}, tier1_procedures=("grant",), salt="k",
    scorer=lambda df: F.when(F.col("sum") >= 0, F.col("sum") / 1000), flag_from=0.9, downgrades=(decisions.Downgrade("flagged", "flagged", "eq", True),),
)


def made(spark, rows):
    return spark.createDataFrame([(i, "d", "scan", None, hint, data, body, None, files) for i, hint, data, body, files in rows], submissions.SCHEMA)


def grant(total, name="Ada Lovelace"):
    return json.dumps({"request": {"kind": "grant", "sum": total}, "person": {"name": name}})


def test_run_journals_every_stage_and_never_fails(spark, tmp_path):
    file = [("f", "text/plain", "x", None, "hurry, Frau Ada Lovelace", None)]
    rows = [
        ("1", None, grant(50), None, None), ("2", None, grant(950), "mail a@b.example", None), ("3", None, grant(None), "x", None), ("4", None, "{broken", "x", None), ("5", None, "[1, 2]", None, None),
        ("6", None, grant(5), "[[PII|forged]]", None), ("7", "grant", None, None, file), (None, None, "{}", " ", None), ("8", "other", grant(-1), None, None), ("9", None, '"text"', None, None),
    ]
    cases = run.run_cases(made(spark, rows), PLAN).cache()
    out = {r["case_id"]: r for r in cases.collect()}
    assert {k: (r["tier"], r["error"]) for k, r in out.items()} == {
        "case-1": (1, None), "case-2": (3, None), "case-3": (2, None), "case-4": (3, "payload"), "case-5": (3, "payload"), "case-6": (3, "boundary"), "case-7": (2, None), "case-": (3, None), "case-8": (1, None), "case-9": (3, "payload"),
    }
    assert out["case-7"]["routed_unit"] == "south" and out["case-6"]["text_normalized"] is None and out["case-4"]["routed_unit"] is None
    kinds = {k: [e["type"] for e in r["events"]] for k, r in out.items()}
    whole = ["RECEIVED", "SEALED", "TEXT_LAYER", "EXTRACTED", "EVIDENCE", "SCORED", "DECIDED"]
    assert kinds["case-1"] == whole and kinds["case-6"] == kinds["case-4"] == ["RECEIVED", "STAGE_FAILED", "DECIDED"]
    assert kinds["case-8"] == [*whole[:5], "SCORE_DEGRADED", "DECIDED"]
    shown = "".join(str(r) for r in out.values())
    assert "Lovelace" not in shown and "a@b" not in shown and "forged" not in shown
    assert not any(r["x"] for r in cases.select(run.holds_raw(cases, F.array(F.lit("Ada"))).alias("x")).collect())
    vault = {(r["case_id"], r["kind"], r["value"]) for r in run.entries(made(spark, rows), PLAN).collect()}
    assert {("case-1", "NAME", "Ada Lovelace"), ("case-2", "EMAIL", "a@b.example"), ("case-7", "NAME", "Ada Lovelace")} <= vault and not any(c == "case-6" for c, _, _ in vault)
    path = str(tmp_path / "journal")
    assert run.append_journal(cases, path) == sum(map(len, kinds.values())) and run.append_journal(cases, path) == 0
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("event_id").distinct().count() == sum(map(len, kinds.values()))


def test_run_of_nothing(spark):
    assert run.run_cases(made(spark, []), PLAN).count() == 0
