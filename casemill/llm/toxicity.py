"""Toxicity by learning from confirmed toxic and unlabelled texts (non-negative PU risk).

A linear logistic classifier is trained with numpy on texts that are confirmed toxic (P) and
on unlabelled ones (U), a sample of all texts; no text is taken as clean.  With the class
prior ``a``, the risk is

    a * mean over P of loss(+)  +  max(0, mean over U of loss(-)  -  a * mean over P of loss(-)).

The second part estimates the risk on clean texts.  Where it falls below zero, which no true
risk does, the classifier fits its sample too closely and the step goes back up that part.
The prior is the toxic share of labelled rows.  A few penalties are tried, and the one with
the lowest such risk (of wrong signs) on rows that it did not learn from is taken.

Inputs of a score are words of the text and beginnings of words, of 3 to 8 letters, so that a
stem is found in all its forms.  The value of an input is log(1 + 100 * share of the words).
Inputs are chosen by how far their means in P and U lie apart, in standard errors.  If none lies
far enough apart, every score is the prior.

Learning takes at most ``Settings.positives`` toxic rows and ``Settings.unlabelled`` other ones,
chosen by a hash of their id; both bounds are parameters.  Rows held out by ``Settings.folds``
are never learned from.  Every row is scored, whole.

Memory: a long text's words are taken in pieces; a task remembers ``Settings.known`` words
without a value; the driver holds one matrix of sampled rows by ``Settings.inputs`` floats.

Cases: null text is empty text, and an empty text is scored by the intercept; null ids are
scored and not learned from; labels other than 0 and 1 do not count; an id with several labels
is toxic if one of them says so; of an id's several texts the smallest is learned from; without
a confirmed toxic row all scores are 0; repeated rows are scored each; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, letter_words, remainder, written


@dataclass(frozen=True)
class Settings:
    positives: int = 4_000
    unlabelled: int = 8_000
    folds: int = 5
    threshold: float = 0.5
    inputs: int = 768
    #: Toxic texts of the sample that have an input, at least.
    least: int = 3
    #: Standard errors between the means of an input in toxic and in unlabelled texts, at least.
    errors: float = 2.5
    shortest: int = 3
    longest: int = 8
    penalties: tuple[float, ...] = (1e-4, 5e-4, 2e-3)
    steps: int = 250
    rate: float = 0.05
    known: int = 500_000
    piece: int = 1 << 22
    seed: int = 11


@dataclass(frozen=True)
class Model:
    #: Word (ends with a blank) or beginning of a word -> weight.
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = float("-inf")
    prior: float = 0.0


def inputs_of(word: bytes, s: Settings) -> list[str]:
    letters = word.decode("utf-8", "replace")
    return [letters + " ", *(letters[:k] for k in range(s.shortest, min(len(letters), s.longest) + 1))]


def _word_counts(text: bytes, s: Settings) -> Counter:
    n: Counter = Counter()
    for words in letter_words(text, s.piece):
        n.update(words)
    return n


def _values(text: bytes, s: Settings) -> dict[str, float]:
    """Every input of a text with its value."""
    n, found = _word_counts(text, s), Counter()
    for word, times in n.items():
        for name in inputs_of(word, s):
            found[name] += times
    total = sum(n.values())
    return {name: float(np.log1p(100 * times / total)) for name, times in found.items()}


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.binary()):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _moments(s: Settings):
    """Sampled texts as rows (input, toxic texts with it, and sums and squares of its values in P and U), summed in the task."""

    def flushed(held: dict[str, list[float]]) -> Iterator[pa.RecordBatch]:
        names = list(held)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([held[x][k] for x in part], pa.float64()) for k in range(5))], names=["name", "texts", "p", "pp", "u", "uu"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[float]] = {}
        for batch in batches:
            for text, toxic in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for name, x in _values(text, s).items():
                    row = held.setdefault(name, [0.0] * 5)
                    if toxic:
                        row[0], row[1], row[2] = row[0] + 1, row[1] + x, row[2] + x * x
                    else:
                        row[3], row[4] = row[3] + x, row[4] + x * x
                if len(held) > s.known:
                    yield from flushed(held)
                    held = {}
        yield from flushed(held)

    return run


def _rows(names: list[str], s: Settings):
    """Sampled texts as sparse rows over the chosen inputs."""
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{place[k]: x for k, x in _values(text, s).items() if k in place} for text in _bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.float32()))],
                names=["toxic", "draw", "places", "shares"],
            )

    return run


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, float]:
    """The written sample (text, toxic, draw), and the prior."""
    learned = lambda df: df.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), s.folds) != 0))
    draw = F.xxhash64("doc_id", F.lit(s.seed))
    marked = learned(labels).where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    positive = marked.where("toxic = 1").select("doc_id").orderBy(draw, "doc_id").limit(s.positives)
    others = learned(docs.select("doc_id")).distinct().orderBy(draw, "doc_id").limit(s.unlabelled)
    chosen = positive.select("doc_id", F.lit(True).alias("toxic")).unionByName(others.select("doc_id", F.lit(False).alias("toxic")))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(texts.select("text", "toxic", draw.alias("draw")), "toxic-sample"), (toxic + 1) / (n + 2)


def _chosen_inputs(sample: DataFrame, s: Settings) -> list[str]:
    n_p, n_u = sample.agg(F.sum(F.col("toxic").cast("int")), F.sum((~F.col("toxic")).cast("int"))).first()
    if not n_p or not n_u:
        return []
    sums = ("texts", "p", "pp", "u", "uu")
    found = sample.select("text", "toxic").mapInArrow(_moments(s), "name string, " + ", ".join(f"{c} double" for c in sums))
    found = found.groupBy("name").agg(*[F.sum(c).alias(c) for c in sums]).where(F.col("texts") >= s.least)
    mean = {"p": F.col("p") / n_p, "u": F.col("u") / n_u}
    error = F.sqrt((F.col("pp") / n_p - mean["p"] ** 2 + 1e-3) / n_p + (F.col("uu") / n_u - mean["u"] ** 2 + 1e-3) / n_u)
    best = found.select("name", F.round((mean["p"] - mean["u"]) / error, 6).alias("t")).where(F.col("t") >= s.errors).orderBy(F.desc("t"), "name").limit(s.inputs)
    return [r["name"] for r in best.collect()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -60, 60))))


def train(p: np.ndarray, u: np.ndarray, prior: float, penalty: float, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and intercept with a low non-negative risk, by Adam over whole batches."""
    w, b = np.zeros(p.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for step in range(1, s.steps + 1):
        at_p, at_u = p @ w + b, u @ w + b
        clean_risk = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        clean_p, clean_u = -prior * _sigmoid(at_p) / len(at_p), _sigmoid(at_u) / len(at_u)
        if clean_risk >= 0:
            on_p, on_u = clean_p - prior * _sigmoid(-at_p) / len(at_p), clean_u
        else:
            on_p, on_u = -clean_p, -clean_u
        gradient = np.append(p.T @ on_p.astype(np.float32) + u.T @ on_u.astype(np.float32) + penalty * w, on_p.sum() + on_u.sum()).astype(np.float32)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), np.float32(b - move[-1])
    return w, float(b)


def sign_risk(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The non-negative risk of wrong signs, from values of the classifier."""
    missed = float((p < 0).mean()) if len(p) else 0.0
    return prior * missed + max(0.0, (float((u >= 0).mean()) if len(u) else 0.0) - prior * (1 - missed))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    sample, prior = _sample(docs, labels, s)
    names = _chosen_inputs(sample, s)
    if not names:
        return Model(intercept=float(np.log(prior / (1 - prior))) if sample.where("toxic").limit(1).count() else float("-inf"), prior=prior)
    table = sample.mapInArrow(_rows(names, s), "toxic boolean, draw long, places array<int>, shares array<float>").toArrow()
    dropped(sample)
    order = np.lexsort((table["toxic"].to_numpy(), table["draw"].to_numpy()))
    x = np.zeros((table.num_rows, len(names)), np.float32)
    lengths = [len(r) for r in table["places"].to_pylist()]
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
    x[np.repeat(np.arange(len(lengths)), lengths), flat("places")] = flat("shares")
    x, toxic = x[order], table["toxic"].to_numpy()[order]
    p, u = x[toxic], x[~toxic]
    apart = lambda m: np.arange(len(m)) % 4 == 0
    risks = []
    for penalty in s.penalties:
        w, b = train(p[~apart(p)], u[~apart(u)], prior, penalty, s) if len(p) >= 8 else (np.zeros(len(names), np.float32), 0.0)
        risks.append(sign_risk(p[apart(p)] @ w + b, u[apart(u)] @ w + b, prior))
    w, b = train(p, u, prior, s.penalties[int(np.argmin(risks))], s)
    return Model({k: float(v) for k, v in zip(names, w, strict=True) if v}, b, prior)


def _scorer(model: Model, s: Settings):
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: set[bytes] = set()
        known: dict[bytes, list[str]] = {}
        for batch in batches:
            values = []
            for text in _bytes(batch.column(2)):
                n = _word_counts(text, s)
                shares: Counter = Counter()
                for word in n.keys() - plain:
                    found = known.get(word)
                    if found is None:
                        found = [k for k in inputs_of(word, s) if k in weights]
                        if found:
                            known[word] = found
                        else:
                            plain.add(word)
                    for name in found:
                        shares[name] += n[word]
                total = sum(n.values())
                values.append(model.intercept + sum(weights[k] * np.log1p(100 * shares[k] / total) for k in sorted(shares)))
                if len(plain) > s.known:
                    plain = set()
                if len(known) > s.known:
                    known = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_sigmoid(np.array(values, float)), pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def scored(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    given = docs.select("doc_id", (remainder(F.col("doc_id"), s.folds) == 0).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = given.mapInArrow(_scorer(model, s), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= s.threshold, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    return scored(docs, fit(docs, labels, s), s)
