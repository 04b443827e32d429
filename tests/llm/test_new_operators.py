"""Operators 11 to 13 against plain Python on small tables, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from casemill.llm import prefix_trie, source_divergence, toxicity

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """node (a tuple of turns) -> expected values, straight from the definition."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        rebuilt[c] = tuple(base[:h] + mine[h:])
    members = collections.defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        childless = [v for v in below if not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in members)]
        ends = ",".join(str(c) for c in convs if rebuilt[c] == node)
        out.append(
            (
                convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), sum(len(w) == len(node) + 1 and w[: len(node)] == node for w in members),
                len(childless), sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def trie_rows(spark, rows, **settings):
    df = spark.createDataFrame(rows, TURNS)
    return [tuple(r) for r in prefix_trie.prefix_trie(df, prefix_trie.Settings(**settings)).collect()]


@pytest.mark.parametrize("settings", [{}, {"hot": 2, "chunk": 40}])
def test_trie(spark, settings):
    rand = random.Random(4)
    said = ["a", "", None, "größe \U0001f600", "bb", "long " * 4000]
    rows = []
    for c in [*range(0, 12), *range(95, 118), 205, 299, 1_000_000_000_007, -3, -150]:
        for t in range(rand.randrange(1, 9)):
            rows.append((c, t if rand.random() < 0.9 else None, rand.choice(["user", "bot", None]), rand.choice(said)))
    rows += rows[:7]
    rows += [(None, 1, "user", "nobody's"), (301, 0, "user", "a")]
    assert sorted(map(str, trie_rows(spark, rows, **settings))) == sorted(map(str, plain_trie(rows)))


def test_trie_of_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000) for t in range(3)]
    got = trie_rows(spark, rows, hot=1, chunk=100)
    assert sorted(map(str, got)) == sorted(map(str, plain_trie(rows)))
    assert max(r[3] for r in got) == 1000


def test_trie_of_long_conversation(spark):
    rows = [(7, t, "user", "x" * (t % 5)) for t in range(5000)] + [(8, t, "user", "x" * (t % 5)) for t in range(4990)]
    got = {r[1]: r for r in trie_rows(spark, rows)}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (7, 8)}
    assert max(got) == 5000 - h[7] and got[0][3] == 2


def test_trie_without_rows_and_with_clashing_names(spark):
    assert trie_rows(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "a", 5, "x")], TURNS + ", family long, node string")
    assert prefix_trie.prefix_trie(df).count() >= 1


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string"


def plain_divergence(rows, least=10, top=10):
    n, documents, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        n.update((lang, source, t) for t in found)
        documents.update((lang, t) for t in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), d in documents.items() if g == lang and d >= least]
        own = {g: {t: n[(*g, t)] for t in kept} for g in groups if g[0] == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (x + 2) // (sum(c.values()) + 2 * len(kept)) for t, x in c.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {g: share(c) for g, c in own.items()}, share(whole)
        for g in own:
            pairs = sorted((-sum(f(p[g][t], p[h][t]) for t in kept), h[1].encode()) for h in own if h != g)
            terms = sorted((-f(p[g][t], q[t]), t.encode()) for t in kept if own[g][t] and p[g][t] > q[t])[:top]
            out |= {(*g, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)}
    return out


def divergence_docs():
    rand = random.Random(9)
    terms = ["The", "of", "größe", "x", "Ärger", "\u0085odd", "don't", "a1b", "\U0001f600", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for i in range(160):
        lang, k = rand.choice(["en", "de", None]), rand.randrange(7)
        rows.append((i, " ".join(rand.choices(terms[k:], k=rand.randrange(0, 40))), lang, f"s{k}" if k else None))
    rows += [rows[0], rows[0], (None, None, "fr", "only"), (7, "", "en", "s9"), (8, "1 2 3", "en", "S1"), (9, "The " * 3000, "en", "s1")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 2, "slice": 3, "heavy": 2, "held": 30, "piece": 16}, {"heavy": 0}, {"heavy": 100, "held": 5}])
@pytest.mark.parametrize("least", [3, 10, 10_000])
def test_divergence(spark, settings, least):
    rows = divergence_docs()
    got = source_divergence.divergence(spark.createDataFrame(rows, DOCS), source_divergence.Settings(least_documents=least, **settings))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows_got = [tuple(r) for r in got.collect()]
    assert len(rows_got) == len(set(rows_got)) and set(rows_got) == plain_divergence(rows, least)


def test_divergence_with_one_hot_source_and_without_rows(spark):
    rows = [(i, "the same words " * 5, "en", "hot" if i % 3 else f"s{i % 40}") for i in range(900)]
    got = source_divergence.divergence(spark.createDataFrame(rows, DOCS))
    assert {tuple(r) for r in got.collect()} == plain_divergence(rows)
    assert source_divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_are_exact_beyond_doubles(spark):
    from pyspark.sql import functions as F

    rows = [(n, total) for n in (0, 1, 10**15, 9 * 10**18 - 7) for total in (1, 3, 10**16 + 1, 9 * 10**18) if n <= total]
    df = spark.createDataFrame(rows, "n long, total long")
    for n, total, share in df.select("n", "total", source_divergence.share(F.col("n"), F.col("total"))).collect():
        assert share == 1 + 1_000_000_000 * (n + 2) // total


TOXIC = "doc_id long, toxic int"
ABUSE = ["vilor", "vilorest", "vilora", "Krampus", "krampus"]


def toxic_docs(n=900, seed=2):
    rand = random.Random(seed)
    plain = ["".join(rand.choices("abcdefghiklmnoprst", k=rand.randrange(2, 9))) for _ in range(400)]
    rows, marks = [], {}
    for i in range(n):
        words = rand.choices(plain, k=rand.randrange(5, 120))
        marks[i] = int(rand.random() < 0.15)
        for _ in range(marks[i] * (1 + len(words) // 30)):
            words.insert(rand.randrange(len(words)), rand.choice(ABUSE))
        rows.append((i, " ".join(words), "en", "s"))
    return rows, marks


@pytest.fixture(scope="module")
def toxic(spark):
    rows, marks = toxic_docs()
    rows += [(10_000, None, "en", "s"), (10_001, "", None, None), (None, "krampus vilor", "en", "s"), rows[3], (10_002, "plain " * 40_000 + "Krampus" * 3, "en", "s")]
    labels = [(i, t) for i, t in marks.items() if i % 2] + [(None, 1), (5, None), (7, 9), (10_000, 0), (77_777, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, TOXIC), rows, marks


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_toxicity_finds_stems_on_held_out_rows(toxic):
    docs, labels, rows, marks = toxic
    got = toxicity.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    unseen = [(marks[r["doc_id"]], r["predicted"]) for r in out if r["doc_id"] in marks and held(r["doc_id"])]
    assert sum(p for t, p in unseen if t) >= 0.95 * sum(t for t, _ in unseen)
    assert sum(p for t, p in unseen if not t) <= 0.01 * len(unseen)
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[10_000] == by_id[10_001] < 0.5 and by_id[None] > 0.5


def test_toxicity_learns_from_no_held_out_label_and_in_any_layout(spark, toxic):
    docs, labels, _, _ = toxic
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.remainder(toxicity.F.col("doc_id"), 5) == 0, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), turned)
    assert a.weights.keys() == b.weights.keys() and abs(a.intercept - b.intercept) < 1e-4
    assert all(abs(a.weights[k] - b.weights[k]) < 1e-4 for k in a.weights)


def test_toxicity_scores_as_plain_python_does(spark, toxic):
    docs, _, rows, _ = toxic
    model, s = toxicity.Model({"vil": 2.0, "krampus ": 3.5, "plain ": -0.5}, -1.0, 0.1), toxicity.Settings(known=3, piece=50)
    got = [r["score"] for r in toxicity.scored(docs.coalesce(1), model, s).collect()]
    for score, (_, text, *_) in zip(got, rows, strict=True):
        words = TERM.findall((text or "").translate(LOWER))
        n = {"vil": sum(w.startswith("vil") for w in words), "krampus ": words.count("krampus"), "plain ": words.count("plain")}
        total = -1.0 + sum(model.weights[k] * math.log1p(100 * c / len(words)) for k, c in n.items() if c)
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_non_negative_risk_beats_taking_unlabelled_as_clean(spark):
    rand = np.random.default_rng(3)
    clean, bad = rand.normal(0, 1, (2000, 6)), rand.normal(1.6, 1, (2000, 6))
    p, u = bad[:300].astype(np.float32), np.concatenate([clean[:1200], bad[300:700]]).astype(np.float32)
    test = np.concatenate([clean[1200:], bad[1200:]]).astype(np.float32)
    truth = np.r_[np.zeros(800), np.ones(800)] > 0
    w, b = toxicity.train(p, u, 0.25, 1e-4)
    right = ((test @ w + b > 0) == truth).mean()
    naive_w, naive_b = toxicity.train(p, u, 300 / 1900, 1e-4)
    assert right > 0.9 and right >= ((test @ naive_w + naive_b > 0) == truth).mean()
    assert toxicity.sign_risk(np.array([1.0, -1.0]), np.array([1.0, -1.0, -1.0, -1.0]), 0.4) == pytest.approx(0.2 + 0.05)
    assert toxicity.sign_risk(np.array([1.0]), np.array([-1.0]), 0.4) == 0.0


def test_toxicity_without_positives_labels_or_rows(spark, toxic):
    docs, labels, rows, _ = toxic
    for marked in (labels.where("toxic = 0"), spark.createDataFrame([], TOXIC)):
        assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, marked).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_toxicity_learns_from_bounded_rows(spark):
    rows = [(1, f"vilor number {i} {'w' * (i % 50)}", "en", "s") for i in range(20_000)] + [(i, "plain words here " * (i % 9), "en", "s") for i in range(2, 400)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i < 40)) for i in range(1, 300)], TOXIC)
    sample, _ = toxicity._sample(docs, labels, toxicity.Settings(positives=10, unlabelled=50))
    assert sample.count() <= 60 and sample.where("toxic").count() == 10


def test_spans_that_keep_apart_against_brute_force(spark):
    from casemill.llm import spans

    rand = random.Random(8)
    rows = []
    for i in range(120):
        n = 3000 if i == 0 else 40
        own, at = [], 0
        for _ in range(rand.randrange(0, n // 4 + 1)):
            at += rand.randrange(0, 6)
            own.append((at, at := at + rand.randrange(1, 5), f"v{at}"))
        others = sorted((a := rand.randrange(n), a + rand.randrange(1, 7)) for _ in range(rand.randrange(0, n // 5 + 1)))
        rows.append((i, own, others))
    df = spark.createDataFrame(rows, "i int, own array<struct<start:int,end:int,value:string>>, others array<struct<start:int,end:int>>")
    for r in spans.with_apart(df, "own", "others", "free").select("i", "free").collect():
        _, own, others = rows[r["i"]]
        assert [tuple(x) for x in r["free"]] == [x for x in own if not any(b < x[1] and x[0] < e for b, e in others)]


def test_secret_scan_of_a_text_with_very_many_spans(spark):
    from casemill.llm import secrets

    text = "password=abcdef123 plain " * 10_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scanned(df, secrets.Model((0.0,) * secrets.SIZE**2, 1.0)).first()
    assert row["sec_n_assign"] == 10_000 and row["sec_all"][-1]["end"] == len(text) - 7


def test_markov_ratio_against_plain_python(spark):
    from pyspark.sql import functions as F

    from casemill.llm import secrets

    rand = random.Random(5)
    table = tuple(round(rand.uniform(-3, 3), 6) for _ in range(secrets.SIZE**2))
    tokens = ["".join(rand.choices(secrets.CHARS + "éß", k=rand.randrange(0, 40))) for _ in range(80)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.Model(table, 0.0).mean_ratio(F.col("t")).alias("x")).collect()
    for r in got:
        codes = [secrets.CHARS.index(c) for c in r["t"] if c in secrets.CHARS]
        pairs = [table[a * secrets.SIZE + b] for a, b in zip(codes, codes[1:], strict=False)]
        assert r["x"] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.0, abs=1e-9)


def test_decision_list_column_against_its_walk(spark):
    from pyspark.sql import functions as F

    from casemill.llm import decision_list

    rand = random.Random(6)
    condition = lambda: decision_list.Condition(rand.choice(decision_list.FEATURES), rand.random() < 0.5, rand.uniform(0, 1))
    chosen = decision_list.DecisionList(tuple(decision_list.Rule(tuple(condition() for _ in range(rand.randrange(1, 4))), rand.random() < 0.5) for _ in range(12)), default=False)
    x = np.array([[rand.uniform(0, 1) for _ in decision_list.FEATURES] for _ in range(300)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{f} double" for f in decision_list.FEATURES))
    got = {r["i"]: r["v"] for r in df.select("i", chosen.column({f: F.col(f) for f in decision_list.FEATURES}).alias("v")).collect()}

    def walk(row):
        for rule in chosen.rules:
            if all((row[c.feature] > c.cut) == c.above for c in rule.conditions):
                return rule.verdict
        return chosen.default

    for i, r in enumerate(x):
        assert got[i] == walk(dict(zip(decision_list.FEATURES, r, strict=True))) == chosen.predict(x[i : i + 1])[0]


def test_every_query_finds_as_many_as_there_are(spark):
    from casemill.llm import nn_descent

    rand = np.random.default_rng(4)
    far = rand.normal(0, 0.05, (588, 8)) + np.repeat(rand.normal(0, 3, (12, 8)), 49, axis=0)
    x = np.concatenate([far, rand.normal(0, 0.05, (12, 8)) + 9])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    s = nn_descent.Settings(shard_size=40, covered=0.05)
    got = nn_descent.nearest(df, 10, s).collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r["query_id"]].append(r)
    assert len(found) == 60
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and len({r["vec_id"] for r in rows} - {q}) == 20
        assert all(r["score"] == pytest.approx(float(x[q] @ x[r["vec_id"]])) for r in rows)
