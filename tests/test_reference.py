"""The reference artifact: canonical bytes, scores against plain Python, drift by rank; ranks over ranges."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.operators import journal, ranks, reference

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def items(spark):
    rand = random.Random(3)
    rows = [(i, rand.gauss(0, 1), float(rand.randrange(5)), rand.random()) for i in range(400)] + [(1000, 9.0, 40.0, 0.5), (1001, None, 1.0, 0.5), (1002, float("nan"), 1.0, 0.5)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


@pytest.fixture(scope="module")
def fitted(items):
    return reference.fit(items.where("id < 1000"), F.col("id"), NAMES, ("a", "b"), most=150, trees=60)


def test_the_artifact_is_the_same_in_any_layout_and_comes_back(spark, items, fitted, tmp_path):
    again = reference.fit(items.where("id < 1000").repartition(7), F.col("id"), NAMES, ("a", "b"), most=150, trees=60)
    path = str(tmp_path / "reference")
    digest = reference.write(spark, fitted, path)
    assert again.document() == fitted.document() and reference.write(spark, again, path) == digest
    back = reference.read(spark, path, NAMES)
    assert back.document() == fitted.document() and back.drift() <= 1e-6
    with pytest.raises(ValueError, match="other features"):
        reference.read(spark, path, ("a", "b"))
    with pytest.raises(ValueError, match="empty"):
        reference.parsed(fitted.document().replace('"item_count"', '"n"').replace(fitted.document().split('"row_ids":')[1].split("]")[0], "["), NAMES)
    with pytest.raises(ValueError, match="empty"):
        reference.fit(items.limit(0), F.col("id"), NAMES, ("a",))


def test_scores_against_plain_python(items, fitted):
    rows = [list(r) for r in fitted.rows]
    depth = lambda x: float(fitted.forest.score(np.array([x]))[0])
    depths = [depth(r) for r in rows]

    def readings(x):
        tails = [min(sum(r[i] <= x[i] for r in rows), sum(r[i] >= x[i] for r in rows)) / len(rows) for i in (0, 1)]
        return sum(d <= depth(x) for d in depths) / len(rows), round(1 - min(tails), 6)

    combined = [max(readings(r)) for r in rows]
    got = {r["id"]: r for r in reference.scored(items, fitted).collect()}
    for r in list(got.values())[:60] + [got[1000]]:
        rank, deviation = readings([r["a"], r["b"], r["c"]])
        assert (r["forest_rank"], r["deviation"]) == pytest.approx((rank, deviation)) and r["score"] == pytest.approx(sum(c <= max(rank, deviation) for c in combined) / len(rows))
    assert got[1000]["score"] == 1.0 and got[1000]["deviation"] == 1.0
    assert all(got[i][c] is None for i in (1001, 1002) for c in ("score", "deviation", "forest_rank"))


def test_drift_of_a_changed_population(spark):
    one = spark.createDataFrame([(float(i),) for i in range(500)] + [(None,)], "s double")
    other = spark.createDataFrame([(float(i) + (3.5 if i == 250 else 0.25),) for i in range(500)], "s double")
    assert tuple(reference.drift_by_rank(one, other, "s").first()) == (500, 500, 1.25)
    assert tuple(reference.drift_by_rank(one, other.limit(10), "s").first()) == (500, 10, None)


def test_running_counts_and_ranks_of_texts_and_numbers(spark):
    rand = random.Random(1)
    for values, kind in ((sorted({"".join(rand.choices("abcxyz", k=rand.randrange(1, 6))) for _ in range(300)}), "string"), (sorted(rand.sample(range(-900, 900), 400)), "long")):
        n = [rand.randrange(0, 9) for _ in values]
        df = spark.createDataFrame(list(zip(values, n, strict=True)), f"v {kind}, n long").repartition(5)
        got = {r["v"]: (r["upto"], r["all"]) for r in ranks.running(df, "v", "n", "upto", "all").collect()}
        assert got == {v: (s, sum(n)) for v, s in zip(values, itertools.accumulate(n), strict=True)}
        assert [r["i"] for r in ranks.ranked(df, "v", "i").orderBy("v").collect()] == list(range(1, len(values) + 1))
    assert ranks.running(df.limit(0), "v", "n", "upto").collect() == []


def test_corrections_of_text_cases(spark):
    overrides = spark.createDataFrame([("b", 2, "e3"), ("a", 1, "e1"), ("b", 1, "e2"), (None, 1, "e9")], "case_id string, at int, event_id string")
    state = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, tier int")
    got = journal.corrections(overrides, state, "case_id", "at", "event_id").orderBy("place").collect()
    assert [(r["place"], r["event_id"]) for r in got] == [(1, "e1"), (2, "e2"), (3, "e3")]
