import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.functions import checksums, dates, paths, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "expected"), [("2026-01-05", dt.date(2026, 1, 5)), (" 2026-01-05 ", dt.date(2026, 1, 5)), ("2026-1-5", None), ("20260105", None), ("2026-02-30", None), ("", None), (None, None)])
def test_iso_date(spark, value, expected):
    assert one(spark, dates.iso_date(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize(("a", "b", "years"), [("2000-02-29", "2001-02-28", 0), ("2000-02-29", "2001-03-01", 1), ("2000-06-15", "1999-06-16", -1), ("2000-01-01", "2000-01-01", 0)])
def test_full_years(spark, a, b, years):
    assert one(spark, dates.full_years(F.lit(a).cast("date"), F.lit(b).cast("date"))) == years


def test_deadlines_skip_weekends_and_holidays(spark):
    sent = F.lit("2024-12-20").cast("date")  # Friday; four days later is the 24th
    free = ("2024-12-24", "2024-12-25", "2024-12-26")
    assert one(spark, dates.delivery_date(sent, free)) == dt.date(2024, 12, 27)
    assert one(spark, dates.response_deadline(sent, 1, free)) == dt.date(2024, 12, 30)
    with pytest.raises(ValueError):
        dates.response_deadline(sent, 0)


def test_checksums(spark):
    assert one(spark, checksums.iban_mod97(F.lit("GB82WEST12345698765432"))) == 1
    assert one(spark, checksums.iban_mod97(F.lit("GB82WEST12345698765433"))) != 1
    assert one(spark, checksums.mod11_10_valid(F.lit("86095742719"))) is True
    assert one(spark, checksums.mod11_10_valid(F.lit("86095742718"))) is False
    assert one(spark, checksums.luhn_valid(F.lit("4111111111111111"))) is True
    assert one(spark, checksums.luhn_valid(F.lit("x"))) is False


def test_json_paths(spark):
    payload = F.lit('{"a": {"b": " x ", "c": [1], "d": true}, "e": ""}')
    get = lambda p: one(spark, paths.json_path(payload, p))
    assert [get(p) for p in ("a.b", "a.c", "a.d", "e", "a", "z.b")] == ["x", None, "true", None, None, None]


def test_normal_text(spark):
    assert one(spark, text.normal_text(F.lit("  a-\n  b \t c - d e-f "))) == "ab c - d e-f"


def test_rendered_and_masked(spark):
    assert one(spark, text.rendered("{a} {b} {c}", {"a": F.lit(1), "b": F.lit(None).cast("string")})) == "1  {c}"
    token = "[[PII|NAME|BCDFGHJKMNPQ]]"
    assert one(spark, text.masked(F.lit(f"x {token} y"))) == "x " + " " * len(token) + " y"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_indel_ratio(a, b):
    expected = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
    assert text.indel_ratio(a, b) == pytest.approx(expected)
