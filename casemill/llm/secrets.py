"""Secret scans with character Markov models (native).

Three fixed patterns give the base spans.  The method adds spans: every maximal
run of ``CHARS`` of at least ``Settings.min_length`` characters is scored by the
log-likelihood ratio of two character Markov models, one of random strings and one
of ordinary identifiers, and is a span if its mean ratio passes a threshold.

Both models are trained from labelled samples: random strings are the values that
the base patterns find plus seeded random hex, base64 and alphanumeric strings;
ordinary identifiers are words of the texts, alone and joined.  Texts for training
are at most ``Settings.sample`` documents, chosen by a hash of their id.  The
threshold leaves ``Settings.false_rate`` of the ordinary samples above it, but no
more than ``Settings.missed_rate`` of the random ones below it (texts may hold
secrets that no pattern knows, so ordinary samples aren't all clean); it is never
below 0.  The tables of the models hold |CHARS|^2 numbers at most, whatever
the input.

Cases: null text is empty text and has no spans; empty tables give an empty
result (the models then rest on the seeded strings alone); repeated rows are
scanned each; only doc_id and text are read by the query, and :func:`redacted`
works in columns with a prefix that no column of the caller has, and keeps all of the
caller's.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, free_prefix, written
from .spans import matches, with_apart

# The base patterns and the shortest value of each.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = ASSIGN.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(CHARS)


@dataclass(frozen=True)
class Settings:
    min_length: int = 20
    sample: int = 1_000
    random_strings: int = 2_000
    smoothing: float = 0.5
    false_rate: float = 1e-4
    missed_rate: float = 0.01
    seed: int = 11

    @property
    def candidate(self) -> str:
        return f"[A-Za-z0-9+/_=-]{{{self.min_length},}}"


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array<struct<start, end, value>>; value is the secret itself.

    For access keys and hex, asking for the shortest length in the pattern finds
    the same spans as dropping short matches, as a run fails or passes whole.
    """
    longer = lambda found, n: F.filter(found, lambda x: F.length(x["value"]) >= n)
    assign = F.transform(
        matches(text, ASSIGN),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_extract(x["value"], ASSIGN_VALUE, 1).alias("value")),
    )
    return {
        "assign": longer(assign, SHORTEST["assign"]),
        "access": matches(text, f"AKIA[A-Z0-9]{{{SHORTEST['access'] - 4},}}"),
        "hex": matches(text, f"[0-9a-f]{{{SHORTEST['hex']},}}"),
    }


def _constant(kind: str, values: Iterable) -> Column:
    """An array of constants as a few expressions, which the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _codes(token: Column) -> Column:
    place = _constant("int", (CHARS.find(chr(i)) for i in range(128)))
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(place, F.ascii(c)), F.lit(-1)))


def _pairs(token: Column) -> Column:
    """Codes of neighbouring characters as one number each; those outside ``CHARS`` are left out."""
    codes = F.filter(_codes(token), lambda c: c >= 0)
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * SIZE + b)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of characters, and the mean ratio from which a run is a secret."""

    ratio: tuple[float, ...]
    threshold: float

    def mean_ratio(self, token: Column) -> Column:
        table = _constant("double", (f"{x:.6f}" for x in self.ratio))
        pairs = _pairs(token)
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p))
        return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(F.lit(0.0))


def labelled_samples(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(token, random): base values and seeded strings are random, words and joined words are not."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.sample)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(ids), "id", "left_semi")
    base = base_spans(F.col("t"))
    values = F.transform(F.concat(*base.values()), lambda x: F.struct(x["value"].alias("token"), F.lit(True).alias("random")))
    plain = F.filter(F.split(F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|[0-9a-f]{{{SHORTEST['hex']},}}", " "), rf"[{SPACE}]+"), lambda w: w.rlike("^[A-Za-z0-9+/_=-]{2,}[.,;:]?$"))
    plain = F.transform(plain, lambda w: F.regexp_replace(w, "[.,;:]$", ""))
    n = F.greatest(F.size(plain) - 1, F.lit(0))
    joined = F.zip_with(F.slice(plain, 1, n), F.slice(plain, 2, n), lambda a, b: F.concat(a, F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), F.pmod(F.xxhash64(a, b), F.lit(4)).cast("int") + 1), b))
    plain = F.transform(F.concat(plain, joined), lambda w: F.struct(w.alias("token"), F.lit(False).alias("random")))
    found = texts.select(F.explode(F.concat(values, plain)).alias("x")).select("x.*")
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    kinds = F.array(digest, base64, F.regexp_replace(base64, "[+/=]", ""), F.upper(F.regexp_replace(base64, "[+/=]", "")))
    seeded = spark.range(s.random_strings).select(F.explode(kinds).alias("token"), F.lit(True).alias("random"))
    return found.unionByName(seeded)


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Counts neighbouring characters of both labels; only |CHARS|^2 sums for each reach the driver."""
    samples = written(labelled_samples(docs, s).groupBy("random", "token").count(), "secret-samples")
    counted = samples.select("random", "count", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.sum("count").alias("n")).collect()
    logs = {}
    for label in (True, False):
        table = [[s.smoothing] * SIZE for _ in range(SIZE)]
        for r in counted:
            if r["random"] is label:
                table[r["pair"] // SIZE][r["pair"] % SIZE] += r["n"]
        logs[label] = [math.log(v / sum(row)) for row in table for v in row]
    ratio = tuple(a - b for a, b in zip(logs[True], logs[False], strict=True))
    score = Model(ratio, 0.0).mean_ratio(F.col("token"))
    long = samples.where(F.length("token") >= s.min_length).select("random", score.alias("x"))
    ordinary, random = long.agg(
        F.expr(f"percentile(x, {1 - s.false_rate}) filter (where not random)"), F.expr(f"percentile(x, {s.missed_rate}) filter (where random)")
    ).first()
    return Model(ratio, max(0.0, min(0.0 if ordinary is None else ordinary, math.inf if random is None else random)))


def scanned(docs: DataFrame, model: Model, s: Settings = Settings(), text: str = "text", prefix: str = "sec_") -> DataFrame:
    """``docs`` with, after a prefix, base (kind number, start, end by start and kind) and all; n_* are counts."""
    raw, p = F.coalesce(F.col(text), F.lit("")), prefix
    base = base_spans(raw)
    df = docs.withColumns({p + k: c for k, c in base.items()} | {p + "runs": matches(raw, s.candidate)})
    listed = lambda name, k: F.transform(F.col(p + name), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    df = df.withColumn(p + "base", F.sort_array(F.concat(*[listed(k, i) for i, k in enumerate(base)])))
    df = with_apart(df, p + "runs", p + "base", p + "free")
    df = df.withColumn(p + "runs", F.filter(p + "free", lambda x: model.mean_ratio(x["value"]) > model.threshold))
    df = df.withColumn(p + "all", F.sort_array(F.concat(p + "base", listed("runs", 3))))
    return df.withColumns({f"{p}n_{k}": F.size(p + k).cast("long") for k in base}).drop(p + "runs", p + "free", *[p + k for k in base])


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets_query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    return scanned(docs, train(docs, s), s).select(
        "doc_id",
        F.col("sec_n_assign").alias("n_assign"),
        F.col("sec_n_access").alias("n_access"),
        F.col("sec_n_hex").alias("n_hex"),
        F.sha2(joined("sec_base"), 256).alias("base_sha256"),
        joined("sec_all").alias("spans"),
    )


def redacted(docs: DataFrame, s: Settings = Settings(), instead: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced; same columns, all rows (n_chars, if there, follows the text)."""
    p = free_prefix(docs, "sec_")
    every = F.col(p + "all")
    found = scanned(docs, train(docs, s), s, prefix=p)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(instead))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    found = found.withColumn("text", F.when(F.size(every) > 0, F.aggregate(every, start, step, end)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)
