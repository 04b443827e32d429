"""What near-duplicates leave on disk while they run."""

from casemill.llm import near_duplicates as nd
from casemill.llm import shared


def test_texts_are_shuffled_once_and_bands_are_deleted(spark, monkeypatch):
    plans, gone = {}, []
    written, dropped = nd.written, nd.dropped

    def told(df, name, *args, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, *args, **options)

    def left(df):
        gone.append(getattr(df, "_casemill_path", ""))
        dropped(df)

    monkeypatch.setattr(nd, "written", told)
    monkeypatch.setattr(nd, "dropped", left)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:59]), " ".join(words), " ".join(reversed(words)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert "hashpartitioning(cls" not in plans["candidate-texts"]
    assert any("/signed-" in path for path in gone)
    assert any("/classes-" in path for path in gone)


def test_texts_that_no_join_finds_are_not_shuffled(spark, tmp_path, monkeypatch):
    parts, sieved = [], shared.sieved

    def told(*args):
        parts.append(sieved(*args))
        return parts[-1]

    monkeypatch.setattr(nd, "small", lambda df: df)  # as if these tables were large
    monkeypatch.setattr(nd, "sieved", told)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, texts[3]), (91, texts[3] + " end"), (4, texts[4]), (None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    out = nd.deduplicated(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == list(range(40))
    assert out.where("text is null").count() == 1
    (near, _), (_, plain) = parts
    assert near.count() < 12 and plain.count() > 32
    assert all("hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString() for df in (near, plain))


def test_sieve_parts_rows_and_loses_none(spark, monkeypatch):
    rows = spark.range(5_000).selectExpr("id as low", "md5(cast(id as string)) as text_hash", "id as sieve_word")
    keys = rows.where("low % 10 = 0").select("low", "text_hash")
    for most in (shared.SIEVE_WORDS, 4):
        monkeypatch.setattr(shared, "SIEVE_WORDS", most)
        may, no = shared.sieved(rows, keys, ["low", "text_hash"])
        assert may.columns == no.columns == rows.columns
        assert may.count() + no.count() == 5_000 and no.where("low % 10 = 0").count() == 0
        assert most == 4 or may.count() < 800
    may, no = shared.sieved(rows, keys.limit(0), ["low", "text_hash"])
    assert may.count() == 0 and no.count() == 5_000


def test_buckets_with_the_same_members_are_worked_off_once(spark, monkeypatch):
    tables, written = {}, nd.written

    def told(df, name, *args, **options):
        tables[name] = written(df, name, *args, **options)
        return tables[name]

    monkeypatch.setattr(nd, "written", told)
    words = [f"w{i}" for i in range(100)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:98])), (3, " ".join(words[30:])), (4, " ".join(words[:40]))]
    members = spark.createDataFrame([(b, c, c) for b in (10, 11, 12) for c in (1, 2, 3)] + [(13, 1, 1), (13, 2, 2), (14, 3, 3), (14, 4, 4)], "band long, cls long, root long")
    links = nd._rest_pairs(members, spark.createDataFrame(texts, "cls long, text string"), nd.Settings())
    assert {tuple(r) for r in links.collect()} == {(2, 1)}
    assert sorted(r["band"] for r in tables["open"].collect()) == [10, 13, 14]
