"""Whole results where a query once gave a part of them, against brute force."""

from casemill.operators import redact, scoring
from casemill.queries import QUERIES


def tables(spark, path, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_quotes_are_found_whole_and_anywhere(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog and then it sleeps until noon"
    quotes = [(1, long), (2, "one two"), (3, "x"), (4, "brown fox jumps"), (5, "ick brown fox jum"), (6, ""), (7, None), (8, "a b c d e f"), (9, long), (10, " two  spaces ")]
    texts = [long, "before " + long + " after, and " + long, long[:40] + " but not the rest", "pre" + long + "post", "zone twofold", "", None, "a b c d e f g", "has two  spaces here", "größe " + long, "x"]
    docs = [*enumerate(texts), (0, long), (None, long)]
    at = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(quotes, "item_id long, text string"))
    got = sorted((str(r["doc_id"]), r["item_id"], r["found"]) for r in QUERIES["quote_at_offset"](spark, at).collect())
    assert got == sorted((str(d), i, True) for d, t in docs for i, q in quotes if t and q and q in t)


def test_fuzzy_quote_compares_whole_texts_of_all_consecutive_turns(spark, tmp_path):
    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    head = "the same beginning " * 12
    turns = [(1, 0, head + "abc def"), (1, 1, head + "xyz " * 40), (1, 2, "something else"), (1, 3, "something more"), (2, 0, "alone"), (3, 0, ""), (3, 1, ""), (4, 0, None), (4, 1, "x"), (5, 2, "late"), (5, 3, "later")]
    at = tables(spark, tmp_path, conversations=(turns, "conv_id long, turn int, text string"))
    got = {(r["conv_id"], r["turn"]): r["ratio"] for r in QUERIES["fuzzy_quote"](spark, at).collect()}
    text = {(c, t): x for c, t, x in turns}
    expected = {(c, t): None if x is None or text[c, t + 1] is None else ratio(x, text[c, t + 1]) for (c, t), x in text.items() if (c, t + 1) in text}
    assert got == expected and len(got) == 6


def test_all_kinds_of_personal_data_are_sealed(spark, tmp_path):
    values = {
        "VSNR": "65170839J003", "STID": "86095742719", "IBAN": "DE89370400440532013000", "BNR": "12345678", "AKTZ": "S 12 R 3456/24", "EMAIL": "a@b.example", "PHONE": "0441 1234567",
        "ADDR": "Lindenstraße 12", "GEBDAT": "1.2.1960", "ORG": "Meyer & Sohn GmbH", "NAME": "Dr. Erika Muster", "SSN": "123-45-6789", "IP": "10.0.0.1", "NUMBER": "4111111111111111",
    }
    before = {"BNR": "Betriebsnummer: ", "GEBDAT": "geboren am ", "NAME": "Frau "}
    rows = [(i, f"größe 😀 ; {before.get(k, '')}{v} ; end") for i, (k, v) in enumerate(values.items())]
    more = [(20, "GB82 WEST 1234 5698 7654 32 TIME x"), (21, "GB82WEST12345698765431"), (22, "26121 Oldenburg"), (23, "[[PII|forged]] text"), (24, "Az. 5 and 5 a@b.example"), (25, None), (26, "+1 (017) 555-7713"), (27, "call (555) 010-1234 or 555-010-1234")]
    at = tables(spark, tmp_path, documents=([*rows, *more], "doc_id long, text string"))
    s = redact.sealed(spark.read.parquet(at + "/documents.parquet"), "doc_id", "text", "k").cache()
    out = {r["doc_id"]: r for r in s.collect()}
    for i, (k, v) in enumerate(values.items()):
        assert [(e["kind"], e["value"]) for e in out[i]["entries"]] == [(k, v)] and v not in out[i]["sealed_text"] and not out[i]["refused"], k
    assert [e["value"] for e in out[20]["entries"]] == ["GB82 WEST 1234 5698 7654 32"] and not out[21]["entries"] and len(out[27]["entries"]) == 2
    assert [i for i, r in out.items() if r["refused"]] == [23]
    back = redact.rehydrated(s.select("doc_id", "sealed_text"), redact.vault(s, "doc_id"), "doc_id", "sealed_text")
    assert {r["doc_id"]: r["plain"] for r in back.collect() if r["doc_id"] != 23} == {i: t for i, t in [*rows, *more] if i != 23}
    assert {r["kind"] for r in QUERIES["pii_counts_by_kind"](spark, at).collect()} == set(values)


def test_ablation_takes_every_row_and_the_forest_has_200_trees(spark, tmp_path, monkeypatch):
    lines = [(i, 1, float(1 + i % 50), 100.0 + i, (i % 11) / 100, (i % 9) / 100) for i in range(120)]
    at = tables(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"))
    got = sorted((r["l_orderkey"], r["feature"], r["contribution"]) for r in QUERIES["ablation"](spark, at).collect())
    assert got == sorted((i, f, v) for i in range(120) for f, v in (("discount", i % 11 - 5), ("quantity", 1 + i % 50 - 25), ("tax", i % 9 - 4)))
    forests, fit = [], scoring.Forest.fit
    monkeypatch.setattr(scoring.Forest, "fit", lambda *a, **k: forests.append(fit(*a, **k)) or forests[-1])
    assert QUERIES["forest_score"](spark, at).count() == 120 and len(forests[0].trees) == 200
