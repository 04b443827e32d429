"""Recognizers against spans that are known by construction, overlaps against plain Python, recall of the recognizers themselves."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from casemill.functions import arrays, recognizers, text
from casemill.operators import boundary, recall, redact

#: Published examples: pension number (pension insurance), tax ids (tax office), IBANs (registry), card numbers (test numbers).
PUBLISHED = {"VSNR": ["65170839J003", "65 170839 J 00 3"], "STID": ["86095742719", "65929970489", "47 036 892 816"], "IBAN": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "CH9300762011623852957"], "NUMBER": ["4111111111111111"]}


def found(spark, rows, profile=recognizers.REDACT):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    out = recognizers.spans(df, "t", "s", profile).select("id", "s").collect()
    return {r["id"]: [tuple(x) for x in r["s"]] for r in out}


def test_published_numbers_are_proven_and_broken_ones_are_not(spark):
    cases = [(k, v) for k, vs in PUBLISHED.items() for v in vs]
    right = found(spark, [f"größe 😀 {v}." for _, v in cases], recognizers.VERIFY)
    assert {i: [(8, 8 + len(v), k, 3)] for i, (k, v) in enumerate(cases)} == {i: [(a, b, k, e) for a, b, k, _, e, _ in x] for i, x in right.items()}
    turn = lambda v: v[:-1] + str((int(v[-1]) + 1) % 10)
    assert not any(found(spark, [turn(v) for _, v in cases], recognizers.VERIFY).values())


def test_the_strongest_hit_names_the_union(spark):
    rand = random.Random(1)
    rows = []
    for _ in range(60):
        hits = [(a := rand.randrange(40), a + rand.randrange(1, 9), rand.choice("AB"), rand.choice("xyz"), rand.randrange(1, 4)) for _ in range(rand.randrange(0, 14))]
        rows.append(sorted(set(hits)))
    told = "".join(chr(97 + i % 26) for i in range(60))
    schema = "id int, h array<struct<start:int,end:int,kind:string,name:string,evidence:int,value:string>>"
    df = spark.createDataFrame([(i, [(*h, told[h[0] : h[1]]) for h in hs]) for i, hs in enumerate(rows)], schema)
    got = df.withColumn("g", recognizers.overlap_groups(F.col("h"))).select("id", recognizers.resolved(F.col("g"), F.lit(told)).alias("s")).collect()
    for r in got:
        groups = []
        for h in rows[r["id"]]:
            if groups and h[0] < max(x[1] for x in groups[-1]):
                groups[-1].append(h)
            else:
                groups.append([h])
        best = [max(g, key=lambda h: (h[4], h[1] - h[0], -h[0], h[2], h[3])) for g in groups]
        assert [tuple(x) for x in r["s"]] == [(g[0][0], e := max(x[1] for x in g), b[2], b[3], b[4], told[g[0][0] : e]) for g, b in zip(groups, best, strict=True)]


def test_evidence_goes_before_length(spark):
    # A tax id that an international telephone number would swallow: the check digit decides the name.
    spans = found(spark, ["+49 86095742719 x"])[0]
    assert [(x[2], x[4]) for x in spans] == [("STID", 3)] and spans[0][:2] == (0, 15)


def test_running_sums_and_masks(spark):
    for n in (0, 1, 127, 128, 129, 1000, 40_000):
        values = [i % 7 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, most = df.select(arrays.running_sum(F.col("v")), arrays.running_max(F.col("v"))).first()
        assert sums == list(itertools.accumulate(values)) and most == list(itertools.accumulate(values, max))
    one = lambda t, p: spark.createDataFrame([(t,)], "t string").select(text.masked(F.col("t"), p)).first()[0]
    assert one("1 12 112", "[0-9]{2}") == "1      2" and one(None, "a") is None and one("", "a") == "" and one("größe 😀a", "[a😀]+") == "größe   "


def test_a_text_with_very_many_spans(spark):
    told = "x@y.example " * 20_000
    spans = found(spark, [told])[0]
    assert len(spans) == 20_000 and spans[-1][:3] == (12 * 19_999, 12 * 19_999 + 11, "EMAIL")


@pytest.mark.parametrize("c", "\n\x0b\x0c\r\x1c\x1d\x1e\x85  ")
def test_hyphens_before_any_line_break_go(spark, c):
    raw = f"Renten-{c}antrag und Renten- antrag"
    native = spark.createDataFrame([(raw,)], "t string").select(text.normal_text(F.col("t"))).first()[0]
    assert native == "Rentenantrag und Renten- antrag" == text.normalized(raw)[0]


def test_recall_of_the_recognizers(spark, tmp_path):
    items = [
        ("a", "Herr Max Muster, Lindenweg 3", [("NAME", 5, 15), ("ADDR", 17, 28)]),
        ("b", "IBAN DE89370400440532013000 and more", [("IBAN", 5, 27)]),
        ("c", "nothing here", []),
        ("d", "call Max, he is in", [("NAME", 5, 8)]),
        ("e", "a@b.example", []),
    ]
    recall.write_labelled(spark.createDataFrame([(i, t, [{"kind": k, "start": a, "end": b} for k, a, b in ls]) for i, t, ls in items], recall.LABELLED), str(tmp_path / "set"))
    report = recall.measured(recall.labelled_texts(spark, str(tmp_path / "set")), gated=("IBAN", "ADDR", "EMAIL"))
    rows = {r["kind"]: (r["n_labels"], r["n_found"], r["n_hits"], r["n_right"], r["gated"], r["passed"]) for r in report.collect()}
    assert rows == {"NAME": (2, 1, 1, 1, False, True), "ADDR": (1, 1, 1, 1, True, True), "IBAN": (1, 1, 1, 1, True, True), "EMAIL": (0, 0, 1, 0, True, True)}
    overall = recall.overall(report).first()
    assert (overall["n_labels"], overall["n_found"], overall["recall"], overall["passed"]) == (2, 2, 1.0, True)
    with pytest.raises(ValueError, match="outside"):
        recall.checked(spark.createDataFrame([("x", "abc", [{"kind": "A", "start": 1, "end": 9}])], recall.LABELLED))
    with pytest.raises(ValueError, match="no item"):
        recall.checked(spark.createDataFrame([], recall.LABELLED))


def test_span_rows_by_profile(spark):
    df = spark.createDataFrame([(1, "65170839J004 and 65170839J003")], "id int, t string")
    kinds = lambda p: [(r["start"], r["evidence"]) for r in boundary.span_rows(df, "id", "t", p).orderBy("start").collect()]
    assert kinds(recognizers.REDACT) == [(0, 1), (17, 3)] and kinds(recognizers.VERIFY) == [(17, 3)]


def test_a_display_form_tells_all(spark):
    home = '{"street":"Lindenweg","no":1,"zip":"10115","town":"Neu  Stadt","more":[null,true,""]}'
    assert redact.tells_all(home, "Lindenweg 1\n10115 Neu Stadt true") and redact.tells_all(home, "true 1 10115 NeuStadt Lindenweg")
    assert not redact.tells_all(home, "Lindenweg 10115 Neu Stadt true") and not redact.tells_all(home, "Lindenweg 1 10115 Neu Stadt true c/o") and not redact.tells_all(home, "")
    assert redact.tells_all("65 170839 J 003", "65170839J003") and not redact.tells_all("65170839J003", "65170839J") and redact.tells_all("{}", " ") and redact.tells_all("12", "1 2")


def test_rehydration_refuses_lossy_forms_and_keeps_null_cases(spark):
    token = lambda c: f"[[PII|ADDR|{c * 12}]]"
    held = spark.createDataFrame([(1, token("B"), '{"no":1,"zip":"10115"}', "10115"), (1, token("C"), "Ada", "Ada"), (None, token("D"), "x", "x")], "c int, token string, value string, display string")
    texts = spark.createDataFrame([(1, f"to {token('B')}"), (1, f"to {token('C')}"), (None, f"to {token('D')}"), (None, "plain"), (2, f"{token('C')}"), (3, None)], "c int, t string")
    got = sorted((str(r["t"]), r["refusal"], r["plain"]) for r in redact.rehydrated_or_refused(texts, held, "c", "t", "display").collect())
    assert got == sorted([(f"to {token('B')}", "lossy", None), (f"to {token('C')}", None, "to Ada"), (f"to {token('D')}", None, "to x"), ("plain", None, "plain"), (token("C"), "unknown_token", None), ("None", None, None)])
    plain = sorted((str(r["t"]), r["plain"]) for r in redact.rehydrated(texts, held, "c", "t").collect())
    assert ("plain", "plain") in plain and (f"to {token('D')}", "to x") in plain
