"""Sealing, offsets, configuration, stores, streams and text helpers against plain Python."""

import hashlib
import json
import math
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.functions import dates, text
from casemill.operators import anomaly, boundary, context, decide, evaluate, evidence, letters, redact, scoring
from casemill.plans import decisions
from casemill.plans.rules import RuleError, compile_rule
from casemill.sources import config, handover, stores
from casemill.streaming import folds


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé é-\n\r\t   B̈x", max_size=24))
def test_offset_maps_lead_back(raw):
    assume(not re.search(r"(^|\s)[\u0300-\u036f]", raw))  # a mark on white space is a character of its own
    normal, starts, ends = text.normalized(raw)
    assert len(normal) == len(starts) == len(ends)
    assert "  " not in normal and normal == normal.strip() and unicodedata.normalize("NFC", normal) == normal
    for i, c in enumerate(normal):
        part = raw[starts[i] : ends[i]]
        assert (part.isspace() and c == " ") or c in unicodedata.normalize("NFC", part)
    assert all(a <= b for a, b in zip(starts, starts[1:], strict=False))


def test_offset_maps_by_hand(spark):
    raw = "  Ver-\n  sicherung,  Café - no\nbreak-  here "
    normal, starts, ends = text.normalized(raw)
    assert normal == "Versicherung, Café - no break- here"
    at = normal.index("sicherung")
    assert raw[starts[at] : ends[at + 8]] == "sicherung" and raw[starts[normal.index("é")] : ends[normal.index("é")]] == "é"
    assert one(spark, text.normal_text(F.lit("a-\r\n b   c "))) == "ab c"
    assert one(spark, text.stripped(F.lit(" \t x y \x1f\n"))) == "x y" and one(spark, text.is_blank(F.lit("\t\n "))) and not one(spark, text.is_blank(F.lit("x")))


def test_blank_values_are_missing(spark):
    df = spark.createDataFrame([(1, "\t\n"), (2, " x")], "id int, a string")
    out = {r["id"]: [tuple(g) for g in r["gaps"]] for r in evidence.completeness(df, (evidence.Requirement("a", "a", min_length=1),)).collect()}
    assert out == {1: [("a", "MISSING", None)], 2: []}


def test_rules_refuse_dates(spark):
    df = spark.createDataFrame([(1,)], "id int").withColumn("d", F.current_date())
    with pytest.raises(RuleError):
        compile_rule({"field": "d", "op": "eq", "value": "2020-01-01"}, df.schema)


def test_payload_sealing(spark):
    fields = (context.IdentityField("p.name", "NAME"), context.IdentityField("p.home", "ADDR", subtree=True), context.IdentityField("p.no", "VSNR"))
    payload = json.dumps({"p": {"name": " Ada ", "home": {"street": "x", "zip": None}, "no": 7, "age": 3}, "q": []})
    sealed, entries = boundary.seal_one(payload, "c1", fields, "k")
    assert [e[:3] for e in entries] == [("p.name", "NAME", "Ada"), ("p.home", "ADDR", '{"street":"x","zip":null}'), ("p.no", "VSNR", "7")]
    assert boundary.seal_one(sealed, "c1", fields, "k") == (sealed, [])
    assert json.loads(sealed)["p"]["age"] == 3 and boundary.seal_one('{"p":{"name":null,"home":{}}}', "c", fields, "k")[1] == []
    token = one(spark, redact.token(F.lit("NAME"), F.lit("c1"), F.lit("Ada"), "k"))
    assert token == entries[0][3]
    with pytest.raises(ValueError):
        context.check_identity((context.IdentityField("a", "X"), context.IdentityField("a.b", "X")))
    with pytest.raises(ValueError):
        context.check_identity((context.IdentityField("a", "X"), context.IdentityField("a", "Y")))


def test_boundary_gives_no_text_of_rejected_cases(spark):
    df = spark.createDataFrame([(1, "a@b.example"), (2, "[[PII|x]]"), (3, None), (4, "plain")], "id int, t string")
    out = {r["id"]: r for r in boundary.passed(df, "id", "t", "k").collect()}
    assert {i: r["outcome"] for i, r in out.items()} == {1: "sealed", 2: "rejected", 3: "clean", 4: "clean"} and out[2]["sealed_text"] is None
    assert [r["id"] for r in boundary.rejected(boundary.passed(df, "id", "t", "k"), "id").collect()] == [2]


def test_span_rows_equal_the_recognizers(spark):
    df = spark.createDataFrame([(1, "a@b.example and 10.0.0.1"), (2, None), (3, "")], "id int, t string")
    rows = boundary.span_rows(df, "id", "t").collect()
    assert sorted((r["id"], r["start"], r["end"], r["kind"]) for r in rows) == [(1, 0, 11, "EMAIL"), (1, 16, 24, "IP")]


def test_fuzzy_spans(spark):
    parts = spark.createDataFrame([(1, "p", "The applicant Jane Doe lives here", "ocr"), (1, "q", "The applicant Jane Doe lives here", "typed")], "c int, part_id string, text string, source_type string")
    rows = [(1, 1, "f", "p", 4, "applicent Jane Doe", "Jane Doe"), (1, 2, "f", "p", 4, "applicant Jane Doe", "Jane Doe"), (1, 3, "g", "p", 14, "Jane Doe", "Jana Doe"), (1, 4, "h", "p", 14, "Jane Doe", "John Smith"), (1, 5, "i", "q", 4, "applicent Jane Doe", "Jane Doe"), (1, 6, "j", "q", 14, "Jane Doe", " jane  DOE ")]
    found = evidence.verified_spans(spark.createDataFrame(rows, "c int, o int, field string, part_id string, start int, quote string, value string"), parts, "c", "o", ("f", "g", "h", "i", "j"), {"ocr": evidence.MatchPolicy(True, 0.85), "typed": evidence.MatchPolicy()})
    out = {r["o"]: (r["failure"], r["mode"], r["confidence"]) for r in found.collect()}
    ratio = round(text.indel_ratio("applicant Jane Doe", "applicent Jane Doe"), 4)
    assert out == {1: (None, "fuzzy", max(0.8, ratio)), 2: ("duplicate_field", None, None), 3: (None, "fuzzy", 1.0), 4: ("value_not_in_quote", None, None), 5: ("quote_mismatch", None, None), 6: (None, "exact", 0.95)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ", max_size=6), st.text(alphabet="ab ", max_size=12))
def test_partial_ratio(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    parts = [long[i : i + n] for i in range(len(long) - n + 1)] + [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    best = max((text.indel_ratio(short, p) for p in parts), default=0.0) if short else float(not long)
    assert text.partial_ratio(a, b) == pytest.approx(best)


def test_configuration(spark, tmp_path):
    (tmp_path / "rules_v2.yaml").write_text("rows: [1]\n")
    (tmp_path / "units.yaml").write_text("units: [a, b]\n")
    assert config.load_config(spark, str(tmp_path), ("rules", "units"), ("scoring",)) == {"rules": {"rows": [1]}, "units": {"units": ["a", "b"]}, "scoring": None}
    with pytest.raises(config.ConfigError):
        config.load_config(None, str(tmp_path), ("queues",))
    (tmp_path / "rules_v3.yaml").write_text("rows: []\n")
    with pytest.raises(config.ConfigError):
        config.load_config(None, str(tmp_path), ("rules",))
    spark.conf.set(config.SETTING, str(tmp_path))
    try:
        assert config.load_config(spark, "/nowhere", ("units",)) == {"units": {"units": ["a", "b"]}}
    finally:
        spark.conf.unset(config.SETTING)
    for check, good, bad in ((config.check_unique, [1, 2], [1, 1]), (config.check_sorted, [1, 2], [2, 1]), (lambda v, w: config.check_subset(v, [1, 2], w), [1], [3])):
        check(good, "x")
        with pytest.raises(config.ConfigError):
            check(bad, "x")
    leaf = lambda f, o, v: {"field": f, "op": o, "value": v}
    assert config.lint_rule({"all": [leaf("p.name", "ne", None), leaf("text", "contains", "x")]}, identity=("p",), texts=("text",)) == []
    assert len(config.lint_rule({"any": [leaf("p.name", "eq", "x"), leaf("text", "eq", "x"), leaf("a", "in", ["12345678", "ok"])]}, identity=("p",), texts=("text",))) == 3
    assert config.lint_rule(leaf("anomaly.score", "gt", 1), qualifying=decide.QUALIFYING) and config.lint_rule({"bad": 1})
    assert config.lint_template("Dear {a}", ("a",)) == [] and len(config.lint_template("Until 1.2.2030 {a}, urgently", ("b",), ("URGENT",))) == 4


def test_decision_table_reads_qualifying_fields_only(spark):
    with pytest.raises(RuleError):
        decide.check_table((decisions.Row("x", {"field": "score", "op": "gt", "value": 1}, 1),))


def test_fallback_and_minima(spark):
    df = spark.createDataFrame([(1, [("a", "rule", 0.5, ["r"]), ("b", "rule", 0.5, ["s"])], "z", 0.9), (2, [], "z", 0.9), (3, [], "z", 0.1), (4, [], None, None)], f"id int, routing {decide.SUGGESTIONS}, u string, s double")
    out = decide.minima(decide.with_fallback(df, F.col("u"), F.col("s"), calibrated=True, least=0.5), ("rule", "classifier"))
    assert {r["id"]: (r["routed_unit"], r["routing_confidence"], r["rule_hit"]) for r in out.collect()} == {1: ("a", 0.5, True), 2: ("z", 0.9, False), 3: (None, 0.0, False), 4: (None, 0.0, False)}
    only_rules = decide.minima(decide.with_fallback(df, F.col("u"), F.col("s"), calibrated=False))
    assert [r["routed_unit"] for r in only_rules.orderBy("id").collect()] == ["a", None, None, None]


def test_stores(spark, tmp_path):
    entries = spark.createDataFrame([("t1", "v"), ("t2", "w")], "token string, value string")
    stores.store_vault(entries, str(tmp_path / "v"))
    for again in (entries.limit(1), spark.createDataFrame([("t9", "a"), ("t9", "b")], "token string, value string")):
        with pytest.raises(ValueError):
            stores.store_vault(again, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    first = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("d", 1, "x")], "case_id string, at int, type string")
    for expected in ([0, 1], [2, 3]):
        events = stores.numbered(first, str(tmp_path / "j"), "case_id", "at").cache()
        assert sorted(r["sequence"] for r in events.where("case_id = 'c'").collect()) == expected
        stores.append_events(events, str(tmp_path / "j"))
    journal = spark.read.parquet(str(tmp_path / "j"))
    assert journal.count() == 6 and journal.select("event_id").distinct().count() == 6
    a, b = spark.createDataFrame([(1, "x", 5)], "k int, v string, at int"), spark.createDataFrame([(1, "x", 9)], "k int, v string, at int")
    assert stores.digest(a, "at") == stores.digest(b, "at") != stores.digest(a)


def test_handover(spark, tmp_path):
    stubs = spark.createDataFrame([("a.xml", "<x/>"), ("b.xml", "<y/>")], "name string, xml string")
    for _ in range(2):
        handover.write_stubs(stubs, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).select("value").collect()) == ["<x/>", "<y/>"]
    schemas = {"stub": stubs.schema}
    assert handover.export_schemas(schemas, str(tmp_path / "s")) == ["stub"] and handover.export_schemas(schemas, str(tmp_path / "s")) == []


def test_live_sessions_as_a_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{m:02}:00") for k, m in ((1, 0), (1, 10), (1, 50), (2, 5), (2, 59))]
    e = spark.createDataFrame(rows, "k int, at string").withColumn("at", F.col("at").cast("timestamp"))
    e.where("k = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    e.where("k = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = folds.live_sessions(folds.event_stream(spark, str(tmp_path / "e"), e.schema, 2), "k", "at", "30 minutes")
    folds.run_available(stream.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")))
    batch = {tuple(r) for r in folds.live_sessions(e, "k", "at", "30 minutes").collect()}
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
    assert closed <= batch and len(batch) == 4


def test_draws_and_embeddings(spark):
    keys = [f"case-{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["d"] for r in df.select("k", decisions.keyed_draw(F.col("k"), F.lit("salt")).alias("d")).collect()}
    assert got == {k: int.from_bytes(hashlib.blake2b(k.encode(), key=b"salt", digest_size=8).digest(), "big") / 2**64 for k in keys} and all(0 <= v < 1 for v in got.values())
    vectors = {r["t"]: np.array(r["v"]) for r in spark.createDataFrame([("Pension claim",), ("pension  CLAIM",), ("tax",), (" ",)], "t string").select("t", text.hashed_embedding("t").alias("v")).collect()}
    assert np.allclose(vectors["Pension claim"], vectors["pension  CLAIM"]) and not vectors[" "].any() and math.isclose(np.linalg.norm(vectors["tax"]), 1) and len(vectors["tax"]) == 96


def test_medians_quartiles_and_reasons(spark):
    assert [one(spark, scoring.median(F.lit(v).cast("array<double>"))) for v in ([1, 2, 3, 4], [3, 1, 2], [5])] == [2.5, 2.0, 5.0]
    assert tuple(one(spark, scoring.quartiles(F.lit([1, 2, 3, 4, 5]).cast("array<double>")))) == (1.5, 3.0, 4.5)
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(c).alias("contribution"), F.lit(o).alias("observed"), F.lit(0.0).alias("expected"), F.lit(0.0).alias("q1"), F.lit(q).alias("q3")) for n, c, o, q in (("b", 0.2, 1.0, 1.0), ("a", 0.2, 3.0, 9.0), ("c", 0.1, 5.0, 0.0))])
    assert one(spark, scoring.top_reasons(parts, 0.15)) == ["a", "b"] and one(spark, scoring.top_reasons(parts, 0.5)) == ["c"]
    assert one(spark, scoring.mean_absolute(parts)) == pytest.approx(0.5 / 3)


def test_calibration_fit(spark):
    df = spark.createDataFrame([(i / 40, (i * 7 % 40) < i) for i in range(40)], "s double, ok boolean")
    steps = evaluate.calibrate(df, "s", F.col("ok"), 5)
    assert steps[-1][0] == 1.0 and [v for _, v in steps] == sorted(v for _, v in steps)
    fitted = df.withColumn("c", evaluate.apply_calibration(F.col("s"), steps))
    raw = evaluate.calibration_error(evaluate.equal_bins(fitted, "s", 5), "s", F.col("ok")).first()[0]
    after = evaluate.calibration_error(evaluate.equal_bins(fitted, "s", 5), "c", F.col("ok")).first()[0]
    assert after <= raw


def test_reference_population(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>")
    anomaly.validate_reference(rows, ("a", "b"), "v", ("a", "b"))
    for bad in (lambda: anomaly.validate_reference(rows, ("a",), "v", ("a", "b")), lambda: anomaly.validate_reference(rows.limit(0), ("a", "b"), "v", ("a", "b")), lambda: anomaly.validate_reference(spark.createDataFrame([([1.0],)], "v array<double>"), ("a", "b"), "v", ("a", "b"))):
        with pytest.raises(ValueError):
            bad()
    sentence = one(spark, anomaly.reason_sentence(F.struct(F.lit("f").alias("feature"), F.lit("x").alias("observed"), F.lit("y").alias("expected"), F.lit(-0.25).alias("contribution"))))
    assert sentence == "f: observed x; expected y; contribution -0.250."


def test_messages_and_wrapping(spark):
    with pytest.raises(ValueError):
        letters.notifications(spark.createDataFrame([(1, "A")], "event_id int, type string"), spark.createDataFrame([], "source_event_id int"), {"A": "Hi {who}"}, {"id": F.lit(1)})
    told = one(spark, text.wrapped(F.lit("word " * 40 + "\n\nend")))
    assert max(map(len, told.split("\n"))) <= 76 and told.endswith("\n\nend")
    assert one(spark, text.tidy(F.lit("a  \n\n\n\n b \t\n"))) == "a\n\n b"
    assert one(spark, dates.rendered_time(F.lit("2024-05-06 07:08:09").cast("timestamp"))) == "06.05.2024 07:08"
