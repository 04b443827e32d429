import random

import pytest
from pyspark.sql import functions as F

from casemill.operators import evaluate, evidence, journal, ranks, redact, review, scoring, spans
from casemill.sources import stores, submissions


def test_routing(spark):
    df = spark.createDataFrame([(1, 5), (2, 15), (3, 25), (4, None)], "id int, n int")
    over = lambda k: {"field": "n", "op": "gt", "value": k}
    rules = (evidence.Route("b", "u2", 1, over(0)), evidence.Route("a", "u1", 1, over(10)), evidence.Route("c", "u2", 0, over(20)))
    out = {r["id"]: (r["winner"], r["unresolved"], r["confidence"], r["conflict"]) for r in evidence.route(df, rules).collect()}
    assert out == {1: ("u2", False, 1.0, False), 2: ("u1", True, 0.6, True), 3: ("u2", False, 1.0, True), 4: (None, False, 0.0, False)}


def test_derivation(spark):
    df = spark.createDataFrame([(1, "a", 1, 0), (2, "a", 0, 0), (3, "a", 0, 1), (4, None, 0, 1), (5, "a", 1, 1), (6, "z", 0, 0)], "id int, hint string, x int, y int")
    signals = {"a": {"field": "x", "op": "eq", "value": 1}, "b": {"field": "y", "op": "eq", "value": 1}}
    out = {r["id"]: (r["derivation"], r["derived"]) for r in evidence.derive(df, F.col("hint"), signals).collect()}
    assert out == {1: ("hint", "a"), 2: ("hint", "a"), 3: ("contradicted", None), 4: ("content", "b"), 5: ("ambiguous", None), 6: ("none", None)}


def test_completeness(spark):
    df = spark.createDataFrame([(1, "AB1x", "2020-01-01"), (2, " ", "2020-13-01"), (3, "ZZ", None)], "id int, a string, d string")
    r = (evidence.Requirement("a", "a", pattern="AB", min_length=3), evidence.Requirement("d", "d", min_date="2000-01-01"), evidence.Requirement("doc", document=True))
    out = {x["id"]: [(g["requirement_id"], g["status"], g["failed"]) for g in x["gaps"]] for x in evidence.completeness(df, r).collect()}
    doc = ("doc", "MISSING", None)
    assert out == {1: [doc], 2: [("a", "MISSING", None), ("d", "INVALID", "date"), doc], 3: [("a", "INVALID", "pattern"), ("d", "MISSING", None), doc]}
    assert {r["verdict"] for r in evidence.completeness(df, ()).collect()} == {"NOT_EVALUABLE"}


def test_first_accepted(spark):
    df = spark.createDataFrame([(1, "f", 1, False), (1, "f", 2, True), (1, "f", 3, True), (1, "f", 4, False)], "c int, f string, o int, ok boolean")
    assert [r["outcome"] for r in evidence.first_accepted(df, "c", "f", "o", "ok").orderBy("o").collect()] == ["rejected", "accepted", "duplicate", "rejected"]


def test_spans_against_brute_force(spark):
    random.seed(4)
    rows = [(k, s := random.randrange(60), s + random.randrange(1, 9), random.choice("ab"), i) for i, k in enumerate(random.choices(range(6), k=90))]
    got = sorted((r["k"], r["start"], r["end"], r["n"]) for r in spans.merged(spark.createDataFrame(rows, "k int, start int, end int, kind string, i int"), "k", "i").collect())
    expected = []
    for k in range(6):
        groups = []
        for _, s, e, _, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if groups and s < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], e)
                groups[-1][2] += 1
            else:
                groups.append([s, e, 1])
        expected += [(k, *g) for g in groups]
    assert got == sorted(expected)


def test_journal(spark, tmp_path):
    e = spark.createDataFrame([(1, "x", 3, "b"), (2, "x", 1, "a"), (3, "y", 2, "a")], "event_id int, case_id string, at int, type string")
    j = journal.sequenced(e, "case_id", "at", "event_id")
    assert {r["event_id"]: r["sequence"] for r in j.collect()} == {2: 0, 1: 1, 3: 0}
    path = str(tmp_path / "j")
    stores.append_events(j, path)
    with pytest.raises(ValueError):
        stores.append_events(j, path)
    state = journal.folded(j, "case_id", {"a": (F.col("type") == "a", F.col("at"))}, ("sequence",))
    assert {r["case_id"]: r["a"] for r in state.collect()} == {"x": 1, "y": 2}


def test_outbox_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "key string, v int")
    path = str(tmp_path / "o")
    assert stores.append_missing(rows, path, "key") == 2
    assert stores.append_missing(rows, path, "key") == 0


def test_labels_are_mandatory(spark):
    items, labels = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "x")], "id int, l string")
    with pytest.raises(ValueError):
        stores.labelled(items, labels, "id")
    with pytest.raises(ValueError):
        stores.labelled(items.limit(0), labels, "id")


def test_census_and_suppression(spark):
    c = spark.createDataFrame([("u", 1), ("u", 2), (None, None)], "unit string, tier int")
    assert sorted(tuple(r) for r in review.census(c, "unit", "tier").collect()) == [("all", "", 3), ("tier", "1", 1), ("tier", "2", 1), ("unit", "clearing", 1), ("unit", "u", 2)]


def test_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 1, 1, 1, 2, 3, 4, 5, 6]], "s int")
    bins = {r["s"]: r["bin"] for r in evaluate.equal_bins(df, "s", 5).collect()}
    # Cuts after 2, 4, 6 and 8 rows; those inside the ones part equal scores, so three bins become one.
    assert bins == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}


def test_bins_against_brute_force(spark):
    rng = random.Random(3)
    for n, k in ((7, 10), (50, 7), (200, 10), (64, 1)):
        values = sorted(rng.randrange(n // 2 + 1) for _ in range(n))
        count, merged = min(k, n), []
        for i in range(count):
            group = values[i * n // count : (i + 1) * n // count]
            if merged and group and merged[-1][-1] == group[0]:
                merged[-1] += group
            elif group:
                merged.append(group)
        expected = {v: i for i, group in enumerate(merged) for v in group}
        got = {r["s"]: r["bin"] for r in evaluate.equal_bins(spark.createDataFrame([(v,) for v in values], "s int"), "s", k).collect()}
        assert got == expected, (n, k)


def test_running_counts_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([-1, 1]) * rng.random() ** 9, rng.randrange(4)) for _ in range(900)]
    got = {r["v"]: (r["upto"], r["all"]) for r in ranks.running(spark.createDataFrame(rows, "v double, n long").repartition(5), "v", "n", "upto", "all").collect()}
    assert got == {v: (sum(k for w, k in rows if w <= v), sum(k for _, k in rows)) for v, _ in rows}


def test_queue_positions(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.25, 1.5, 7.0, rng.random() * 90])) for i in range(300)]
    got = {r["case_id"]: r["position"] for r in review.queue(spark.createDataFrame(rows, "case_id int, queue string, h double"), F.col("h")).collect()}
    for q in ("a", "b", None):
        order = sorted((r for r in rows if r[1] == q), key=lambda r: (-(r[2] or 0.0), r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_isotonic_and_calibration(spark):
    assert evaluate.isotonic([0.1, 0.5, 0.3, 0.9], [1, 1, 1, 1]) == pytest.approx([0.1, 0.4, 0.4, 0.9])
    df = spark.createDataFrame([(i / 20, i > 9) for i in range(20)], "s double, ok boolean")
    steps = evaluate.calibrate(df, "s", F.col("ok"), 4)
    assert steps[-1][0] == 1.0 and [v for _, v in steps] == [0.0, 0.0, 1.0, 1.0]
    assert spark.range(1).select(evaluate.apply_calibration(F.lit(0.05), steps)).first()[0] == 0.0


def test_seal_and_rehydrate(spark):
    d = spark.createDataFrame([(1, "mail a@b.example and 10.0.0.1, a@b.example"), (2, None), (3, "")], "id int, text string")
    s = redact.sealed(d, "id", "text", "k").cache()
    rows = {r["id"]: r for r in s.collect()}
    assert "a@b" not in rows[1]["sealed_text"] and len(rows[1]["entries"]) == 2 and not rows[1]["refused"]
    back = redact.rehydrated(s.select("id", "sealed_text"), redact.vault(s, "id"), "id", "sealed_text")
    assert {r["id"]: r["plain"] for r in back.collect()} == {1: "mail a@b.example and 10.0.0.1, a@b.example", 2: None, 3: ""}
    unknown = spark.createDataFrame([(1, "[[PII|X|BCDFGHJKMNPQ]]")], "id int, sealed_text string")
    assert redact.rehydrated(unknown, redact.vault(s, "id"), "id", "sealed_text").first()["plain"] is None


def test_forest_finds_the_outlier():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(400, 3))
    x[7] = 9
    score = scoring.Forest.fit(x, 50).score(x)
    assert score.argmax() == 7 and (score > 0).all() and (score <= 1).all()


def test_submissions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"submissionId":"s1","channel":"scan","bodyText":"hello","attachments":[{"text":" "},{"text":"more","sourceType":"email"}],"data":{"a":{"b":1}},"extra":2}\n')
    s = submissions.read_submissions(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in submissions.text_parts(s).orderBy("ordinal").collect()] == [("s1", "part-text-1", 0, "hello", "ocr"), ("s1", "part-text-2", 1, "more", "email")]
    assert [r["ref_id"] for r in submissions.attachment_refs(s).collect()] == ["s1-att-1", "s1-att-2"]
    same = spark.createDataFrame([('{"a":1,"b":{"d":2,"c":3}}',), ('{"b":{"c":3,"d":2},"a":1}',)], "p string").select(submissions.payload_digest(F.col("p"))).distinct()
    assert same.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from casemill.streaming import folds

    e = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(20)], "event_id long, case_id long, type string")
    for part in range(2):
        e.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = folds.event_stream(spark, str(tmp_path / "e"), e.schema)
    got = folds.stream_state(stream, "case_id", F.col("event_id"), F.col("type"), str(tmp_path / "c"))
    batch = e.groupBy("case_id").agg(F.max_by("type", "event_id").alias("latest"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
