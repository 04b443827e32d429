import pytest
from pyspark.sql import functions as F

from casemill.plans import decisions
from casemill.plans.rules import RuleError, compile_rule, validate


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "abc", 5.0, True), (2, None, None, None), (3, "Straße", -1.0, False)], "id int, s string, n double, b boolean").cache()


def holds(rows, field, op, value):
    return [r[0] for r in rows.where(compile_rule({"field": field, "op": op, "value": value}, rows.schema)).orderBy("id").select("id").collect()]


@pytest.mark.parametrize(
    ("field", "op", "value", "expected"),
    [
        ("s", "eq", "abc", [1]), ("s", "eq", None, []), ("s", "ne", None, [1, 3]), ("s", "ne", 5, [1, 3]), ("n", "ne", "5", [1, 3]),
        ("n", "eq", 5, [1]), ("b", "eq", 1, []), ("b", "eq", True, [1]), ("n", "gt", 0, [1]), ("s", "gt", 0, []), ("n", "le", 5, [1, 3]),
        ("s", "in", ["abc", 5], [1]), ("s", "in", "xabcx", [1]), ("s", "contains", "STRASSE", [3]), ("s", "matches", "^A", [1]), ("n", "contains", "5", []),
        ("gone", "ne", None, []), ("gone", "eq", "abc", []),
    ],
)
def test_leaf(rows, field, op, value, expected):
    assert holds(rows, field, op, value) == expected


def test_empty_all_and_any(rows):
    assert rows.where(compile_rule({"all": []}, rows.schema)).count() == 3
    assert rows.where(compile_rule({"any": []}, rows.schema)).count() == 0


@pytest.mark.parametrize("bad", [{"all": [], "any": []}, {"field": "s", "op": "like", "value": 1}, {"field": "s", "op": "eq"}, {"field": "s", "op": "matches", "value": "("}, "x"])
def test_bad_rules(bad):
    with pytest.raises(RuleError):
        validate(bad)


def test_first_match_and_default(rows):
    table = (decisions.Row("a", {"field": "n", "op": "gt", "value": 0}, 1), decisions.Row("b", {"field": "s", "op": "ne", "value": None}, 2))
    out = {r["id"]: (r["tier"], r["row_id"], r["failed"]) for r in decisions.decide(rows, table, failed="failed").collect()}
    assert out == {1: (1, "a", 0), 2: (3, "default", 2), 3: (2, "b", 1)}


def test_downgrade_only_raises_and_only_if_enforcing(rows):
    df = rows.select("id", F.lit(1).alias("tier"), F.coalesce("n", F.lit(0.0)).alias("score"))
    rules = (decisions.Downgrade("high", "score", "ge", 5.0),)
    on = {r["id"]: r["final_tier"] for r in decisions.downgrade(df, rules, "tier", enforcing=True).collect()}
    off = {r["id"]: (r["final_tier"], list(r["fired"])) for r in decisions.downgrade(df, rules, "tier", enforcing=False).collect()}
    assert on == {1: 3, 2: 1, 3: 1} and off == {1: (1, ["high"]), 2: (1, []), 3: (1, [])}
    with pytest.raises(RuleError):
        decisions.Downgrade("low", "score", "lt", 1.0)


def test_audit_sample_is_off_without_salt_and_repeatable(spark):
    df = spark.range(2000).select("id", F.lit(1).alias("tier"))
    assert decisions.audit_sample(df, "id", 0.1, "", "tier").where("sampled").count() == 0
    once = decisions.audit_sample(df, "id", 0.1, "s", "tier").where("sampled").count()
    assert once == decisions.audit_sample(df, "id", 0.1, "s", "tier").where("tier = 3").count() and 120 < once < 280
