"""Findings of round 4: each test failed before its finding was settled."""

import glob

from casemill.operators import run

CASES = "case_id string, created_at timestamp, events array<struct<type:string,detail:string>>"


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_journal_makes_its_events_once_for_an_append(spark, tmp_path):
    """The events of a new journal are written in one pass: not made again to find their buckets and to be counted."""
    event = lambda n: [(f"T{i}", "{}") for i in range(n)]
    path = str(tmp_path / "journal")
    cases = lambda *rows: spark.createDataFrame([(k, None, event(n)) for k, n in rows], CASES)
    n, jobs = jobs_of(spark, "first", lambda: run.append_journal(cases(("a", 3), ("b", 7), ("b", 2), ("b", 7), ("c", 0)), path))
    assert n == 10 and jobs <= 2
    # a part of the journal is lost, a case goes on, and one is new: just what lacks is appended
    kept = spark.read.parquet(path).where("not (case_id = 'b' and sequence in (2, 5))").collect()
    again = str(tmp_path / "again")
    spark.createDataFrame(kept, spark.read.parquet(path).schema).write.partitionBy("case_bucket").parquet(again)
    more = cases(("a", 4), ("b", 7), ("d", 2))
    assert run.append_journal(more, again) == 5 and run.append_journal(more, again) == 0
    rows = spark.read.parquet(again).select("case_id", "sequence", "type", "event_id").collect()
    assert sorted((r["case_id"], r["sequence"], r["type"]) for r in rows) == [(k, i, f"T{i}") for k, n in (("a", 4), ("b", 7), ("d", 2)) for i in range(n)]
    assert len({r["event_id"] for r in rows}) == len(rows) and glob.glob(f"{again}/case_bucket=*")
