"""Findings of round 3: each test failed before its finding was settled."""

import numpy as np
import pandas as pd

from casemill import queries_boundary  # noqa: F401  registers its queries
from casemill.functions import text
from casemill.llm import class_ngrams
from casemill.operators import boundary, evidence, scoring
from casemill.queries import QUERIES

from test_findings import tables


def test_a_leap_day_of_2000_agrees_with_its_number(spark, tmp_path):
    rows = [(52569, "a", 1.0), (52575, "b", -1.0), (1, "c", 0.0)]
    at = tables(spark, tmp_path, customer=(rows, "c_custkey long, c_name string, c_acctbal double"))
    got = {r["c_custkey"]: (r["number"], r["start"], r["sealed"]) for r in QUERIES["completeness_across_fields"](spark, at).collect()}
    assert got == {52569: (None, "min_years_after", None), 52575: (None, "min_years_after", None), 1: ("birth_in_number", None, "unresolved")}
    alone = spark.createDataFrame([(1, "12290200A001", None), (2, "12290200A001", "2000-02-29"), (3, "12290200A001", "1900-02-28"), (4, "12290204A001", None), (5, "12310299A001", None), (6, "12x", "2000-02-29")], "id int, n string, born string")
    out = evidence.completeness(alone, (evidence.Requirement("n", "n", birth_in_number="born"),)).collect()
    assert [r["id"] for r in out if r["gaps"]] == [1, 3, 5, 6]


def test_letters_of_a_placeholder_are_no_residue(spark):
    """The token of case-783168 holds 11 digits in a row whose check digit holds, that of case-2744946 too."""
    rows = [("case-783168", "write to c79157@mail.example"), ("case-2744946", "write to c271305@mail.example"), ("case-1", "write to c1@mail.example"), ("case-2", "nothing"), ("case-3", "[[PII|forged]] and a@b.example")]
    df = spark.createDataFrame(rows, "id string, told string")
    out = {r["id"]: r for r in boundary.passed(df, "id", "told", "s").collect()}
    assert {k: r["outcome"] for k, r in out.items()} == {"case-783168": "sealed", "case-2744946": "sealed", "case-1": "sealed", "case-2": "clean", "case-3": "rejected"}
    assert out["case-783168"]["sealed_text"] == "write to [[PII|EMAIL|89295284935X]]" and [e["value"] for e in out["case-783168"]["entries"]] == ["c79157@mail.example"]
    again = spark.createDataFrame([("a", "[[PII|EMAIL|89295284935X]] 89295284935 ")], "id string, told string")
    assert boundary.passed(again, "id", "told", "s").first()["sealed_text"].startswith("[[PII|EMAIL|89295284935X]] [[PII|STID|")


def test_forest_is_walked_like_a_plain_tree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)).round(1)
    forest = scoring.Forest.fit(x, trees=20, sample=64)
    x[0, 1], x[1], x[2] = np.nan, np.inf, -np.inf

    def depth(row, feature, cut, left, right, length):
        at, steps = 0, 0
        while feature[at] >= 0:
            at, steps = (left if row[feature[at]] < cut[at] else right)[at], steps + 1
        return length[at], steps

    found = [[depth(row, *tree) for tree in forest.trees] for row in x]
    assert np.array_equal(forest.score(x), 2.0 ** (-(np.array([sum(d for d, _ in f) for f in found]) / 20) / scoring._mean_depth(64)))
    heights = [scoring._height(*tree[0:1], *tree[2:4]) for tree in forest.trees]
    assert all(max(f[i][1] for f in found) <= h <= 6 for i, h in enumerate(heights)) and scoring.Forest.fit(x[3:4], trees=2).score(x[:5]).shape == (5,)


def test_offsets_of_a_large_batch_are_handed_on_piece_by_piece(spark):
    frames = list(text.normal_text_map.func(iter([pd.Series(["a  b", None, ""] * 1000), pd.Series(["x-\ny"])])))
    assert [len(f) for f in frames] == [text.PIECE] * 15 + [1] and frames[0]["starts"][0].dtype == np.int32
    assert [(r.text, list(r.starts), list(r.ends)) for r in frames[-1].itertuples()] == [("xy", [0, 3], [1, 4])]
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a " * (i % 5) + f"b\n{i}") for i in range(1500)], "i int, t string").coalesce(1)
    got = {r["i"]: r["m"] for r in rows.select("i", text.normal_text_map("t").alias("m")).collect()}
    for i, t in ((i, "a " * (i % 5) + f"b {i}") for i in range(1500)):
        assert i % 7 == 0 and got[i]["text"] is None and got[i]["starts"] is None or (got[i]["text"], got[i]["starts"]) == (t, list(range(len(t))))


def test_class_ngrams_take_a_large_batch_in_pieces():
    frame = pd.DataFrame({"units": [b"ab"] * 2500})
    found = list(class_ngrams._pieces(iter([frame, frame[:3], frame[:0]])))
    assert [len(f) for f in found] == [1000, 1000, 500, 3]
