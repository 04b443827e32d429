"""Scoring with a Brown class-based bigram model.

P(word | word before) = P(class of word | class before) * P(word | its class).

1. Words of the training texts are counted; counts stay a distributed table.  The most
   frequent words (``Settings.head`` at most, by a threshold that a histogram of the
   counts gives) are also broadcast; all others are looked up by joins.
2. Exchange clustering of the ``Settings.core`` most frequent words, on the counts of
   their bigrams: sweep by sweep every word moves to the class that raises the
   likelihood of the class bigrams most.  Counts are updated with each move, so a
   sweep never lowers the likelihood.  All other words are one unit of a class of its own.
3. Every other word that was seen leaves that class for the best one, given how often
   it stands after and before each class.  Its counts are small against those of
   classes, so the gain is taken to first order, a product of two matrices.  Such words
   and their classes are a table that grows with the corpus.
4. Class bigrams are then counted over the classes of all words, and texts are scored.

Transitions are interpolated with class frequencies.  Emissions are
(count + 1) / (count of the class + its words + 1): as in the base score, the words that
training never saw are one type, here in each class.  An unseen word is thus as likely
as all classes together make that type, half as likely as a word that was seen once;
it tells nothing of the next class.  After each context, the probabilities of all seen
words, of the end and of the unseen type sum to 1.

Cases: null text is empty text, which is the end token alone; without training
rows every token is unseen; repeated rows count and are scored each; null ids are
hashed as empty text; only doc_id and text are read; very long texts are scored
whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TEXT_BATCH, dropped, remainder, written

#: Different words that a task counts before it hands them on.
FLUSH = 300_000
#: Unit and class of the end token, which is also the context of a first word.
END = 0
#: Class of all words that are not clustered yet, then of unseen words.
REST = 1
#: Unit of a word outside the head.
TAIL = 0xFFFF


@dataclass(frozen=True)
class Settings:
    folds: int = 7
    held_out: int = 2
    head: int = 60_000
    core: int = 2_048
    classes: int = 64
    sweeps: int = 6
    smoothing: float = 20.0

    def __post_init__(self) -> None:
        if not (2 < self.classes < 256 and self.core <= self.head < TAIL):
            raise ValueError("classes must fit into a byte, and the head into 16 bits")


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: ``bytes.lower`` changes A-Z alone, ``bytes.split`` parts at 0x20 and 0x09-0x0D alone."""
    return (raw or b"").lower().split()


def _raw(docs: DataFrame):  # noqa: ANN202
    return F.col("text").cast("binary").alias("text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; words are bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        flushed = lambda: pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
        for frame in frames:
            for text in frame["text"]:
                held.update(tokens(text))
                if len(held) > FLUSH:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    return docs.select(_raw(docs)).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Head:
    """Broadcast part of the vocabulary, by falling count (unit i + 1 is words[i]), and the sizes of the whole."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    n_core: int
    n_tokens: int
    n_types: int
    n_ends: int

    @property
    def floor(self) -> float:
        return float(np.log10(self.n_tokens + self.n_types + 1))


def _head(vocabulary: DataFrame, n_ends: int, s: Settings) -> Head:
    """Words from a step of counts on, chosen so that there are ``s.head`` at most; steps are eighths of an octave."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    total = {"n": 0, "v": 0}
    least, held = None, 0
    steps = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    for r in sorted(steps, key=lambda r: -r["step"]):
        total["n"] += r["n"]
        total["v"] += r["v"]
        held += r["v"]
        if held <= s.head:
            least = r["step"]
    top = vocabulary.where(step >= least).collect() if least is not None else []
    top = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda r: (-r[1], r[0]))
    return Head(tuple(w for w, _ in top), np.array([n for _, n in top], np.int64), min(s.core, len(top)), total["n"] + n_ends, total["v"] + (n_ends > 0), n_ends)


class _Units(dict):
    def __missing__(self, key: bytes) -> int:
        return TAIL


def _encoded(docs: DataFrame, head: Head, s: Settings) -> DataFrame:
    """Each text as units; words outside the head as a list of different ones, and which of them each TAIL is."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, units binary, tail_words array<binary>, tail_at binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value
        table = _Units((w, i) for i, w in enumerate(h.words, 1))
        logs = np.zeros(TAIL + 1)
        logs[1 : len(h.words) + 1] = np.log10(h.counts + 1)
        for frame in frames:
            out = []
            for text in frame["text"]:
                found = tokens(text)
                units = np.fromiter(map(table.__getitem__, found), np.uint16, len(found))
                tail: dict[bytes, int] = {}
                places = np.flatnonzero(units == TAIL).tolist()
                at = np.fromiter((tail.setdefault(found[i], len(tail)) for i in places), np.uint32, len(places))
                out.append((len(found) + 1, len(found) - len(places) + (h.n_ends > 0), float(logs[units].sum()), units.tobytes(), list(tail), at.tobytes()))
            rest = pd.DataFrame(out, columns=["n_tokens", "known", "logs", "units", "tail_words", "tail_at"])
            yield pd.concat([frame[["uid", "doc_id", "held_out"]].reset_index(drop=True), rest], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (remainder(F.col("doc_id"), s.folds) == s.held_out).alias("held_out"), _raw(docs))
    return rows.mapInPandas(run, schema)


def _flat(column: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(b, kind) for b in column]
    return (np.concatenate(parts) if parts else np.empty(0, kind)).astype(np.int64), np.array([len(x) for x in parts], np.int64)


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of ``TEXT_BATCH`` rows at most: numbers of 64 bits for each token are made of one piece at a time."""
    for frame in frames:
        for at in range(0, len(frame), TEXT_BATCH):
            yield frame.iloc[at : at + TEXT_BATCH]


def closed(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Texts one after the other, each closed by END."""
    whole = np.full(len(flat) + len(lengths), END, np.int64)
    inside = np.ones(len(whole), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    whole[inside] = flat
    return whole


def _before(whole: np.ndarray) -> np.ndarray:
    return np.concatenate([[END], whole[:-1]]) if len(whole) else whole


def core_bigrams(encoded: DataFrame, n_core: int) -> np.ndarray:
    """How often each unit of the core (END first, all others last) stands before each: one matrix of a fixed size."""
    size = n_core + 2
    slices = 16
    width = -(-size // slices)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size * size, np.int64)
        for frame in _pieces(frames):
            whole = closed(*_flat(frame["units"], "<u2"))
            whole = np.where(whole > n_core, n_core + 1, whole)
            pairs, n = np.unique(_before(whole) * size + whole, return_counts=True)
            sums[pairs] += n
        sums = sums.reshape(size, size)
        rows = [(i, zlib.compress(sums[i * width : (i + 1) * width].tobytes(), 1)) for i in range(slices)]
        yield pd.DataFrame(rows, columns=["slice", "data"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in frame["data"])
        return pd.DataFrame({"slice": [int(frame["slice"].iloc[0])], "data": [zlib.compress(total.tobytes(), 1)]})

    parts = encoded.select("units").mapInPandas(run, "slice int, data binary").groupBy("slice").applyInPandas(add, "slice int, data binary").collect()
    out = np.zeros((size, size), np.int64)
    for i, data in parts:
        block = np.frombuffer(zlib.decompress(bytes(data)), np.int64).reshape(-1, size)
        out[i * width : i * width + len(block)] = block
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_bigrams(bigrams: np.ndarray, classes: np.ndarray, c: int) -> np.ndarray:
    """N(class before, class) from the counts of unit bigrams."""
    rows = np.zeros((c, bigrams.shape[1]))
    np.add.at(rows, classes, bigrams)
    out = np.zeros((c, c))
    np.add.at(out.T, classes, rows.T)
    return out


def likelihood(n2: np.ndarray) -> float:
    return float(_xlogx(n2).sum() - _xlogx(n2.sum(0)).sum() - _xlogx(n2.sum(1)).sum())


def exchange(bigrams: np.ndarray, s: Settings) -> np.ndarray:
    """Classes of units: END and the last unit keep theirs, all others move where the likelihood is highest.

    Units go by falling count; the counts of classes are those of the moment, without the unit that moves.
    """
    c, size = s.classes, len(bigrams)
    b = bigrams.astype(float)
    classes = 2 + np.arange(size) % (c - 2)
    classes[0], classes[-1] = END, REST
    n2 = class_bigrams(b, classes, c)
    counts = b.sum(0)
    diagonal = np.arange(c)
    for _ in range(s.sweeps):
        moved = 0
        for u in (1 + np.argsort(-counts[1:-1], kind="stable")).tolist():
            own, old = b[u, u], classes[u]
            left, right = np.bincount(classes, b[:, u], c), np.bincount(classes, b[u], c)
            left[old] -= own
            right[old] -= own
            n2[:, old] -= left
            n2[old] -= right
            n2[old, old] -= own
            with_u, plain = n2 + left[:, None], _xlogx(n2)
            gain = (_xlogx(with_u) - plain).sum(0) + (_xlogx(n2 + right[None, :]) - plain).sum(1)
            # On the diagonal both meet, and the unit's own bigram.
            d = n2[diagonal, diagonal]
            gain += _xlogx(d + left + right + own) + _xlogx(d) - _xlogx(d + left) - _xlogx(d + right)
            for totals in (n2.sum(0), n2.sum(1)):
                gain -= _xlogx(totals + counts[u]) - _xlogx(totals)
            gain[:2] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            n2[:, new] += left
            n2[new] += right
            n2[new, new] += own
            moved += new != old
            classes[u] = new
        if not moved:
            break
    return classes


def _contexts(encoded: DataFrame, head: Head, classes: np.ndarray, s: Settings) -> DataFrame:
    """(word, code, n) of the words outside the core: code is the class before, or the class after plus their number."""
    shared = encoded.sparkSession.sparkContext.broadcast((head, classes))
    c = s.classes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, own = shared.value
        class_of = np.full(TAIL + 1, REST, np.int64)
        class_of[: h.n_core + 1] = own[:-1]
        first = len(h.words) + 1
        for frame in frames:
            lists = [np.asarray(x, object) for x in frame["tail_words"]]
            at, n_at = _flat(frame["tail_at"], "<u4")
            begin = np.cumsum([0, *[len(x) for x in lists]])[: len(lists)]
            codes, names = pd.factorize(np.concatenate(lists)) if lists else (np.empty(0, np.int64), np.empty(0, object))
            tail, used, counted = first + codes[at + np.repeat(begin, n_at)], 0, []
            for piece in _pieces(iter([frame[["units"]]])):
                whole = closed(*_flat(piece["units"], "<u2"))
                ids, places = whole.copy(), np.flatnonzero(whole == TAIL)
                ids[places] = tail[used : used + len(places)]
                used += len(places)
                cls = class_of[whole]
                before, after = _before(cls), np.concatenate([cls[1:], [END]])[: len(cls)]
                outside = np.flatnonzero(whole > h.n_core)
                counted.append(np.unique(np.concatenate([ids[outside] * 2 * c + before[outside], ids[outside] * 2 * c + c + after[outside]]), return_counts=True))
            keys, at = np.unique(np.concatenate([k for k, _ in counted] or [np.empty(0, np.int64)]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, np.concatenate([m for _, m in counted] or [np.empty(0, np.int64)]))
            words = np.concatenate([np.array([b"", *h.words], object), names])
            yield pd.DataFrame({"word": words[keys // (2 * c)], "code": (keys % (2 * c)).astype(np.int16), "n": n})

    return encoded.select("units", "tail_words", "tail_at").mapInPandas(run, "word binary, code short, n long")


def word_classes(encoded: DataFrame, head: Head, s: Settings) -> tuple[DataFrame, np.ndarray]:
    """(word, n, cls) of all words outside the core, and the classes of the core's units (END first, the rest last)."""
    bigrams = core_bigrams(encoded, head.n_core)
    classes = exchange(bigrams, s)
    n2 = class_bigrams(bigrams, classes, s.classes)
    logs, totals = np.log(n2 + 0.5), np.log(n2.sum(0) + 0.5 * s.classes)
    contexts = _contexts(encoded, head, classes, s).repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n"))
    listed = contexts.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("around")).select("word", F.col("around.code").alias("codes"), F.col("around.n").alias("ns"))
    c = s.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("codes").value_lengths(), np.int64)
            around = np.zeros((len(sizes), 2 * c))
            np.add.at(around, (np.repeat(np.arange(len(sizes)), sizes), np.asarray(batch.column("codes").flatten(), np.int64)), np.asarray(batch.column("ns").flatten(), np.int64))
            n = around[:, :c].sum(1)
            gain = around[:, :c] @ logs + around[:, c:] @ logs.T - 2 * n[:, None] * totals
            gain[:, :2] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n.astype(np.int64)), pa.array(gain.argmax(1).astype(np.int16))], ["word", "n", "cls"])

    return written(listed.mapInArrow(run, "word binary, n long, cls short"), "word-classes"), classes


def _classed(encoded: DataFrame, named: DataFrame, head: Head, core: np.ndarray, s: Settings) -> DataFrame:
    """Each text as the classes of its words (REST: unseen), with what its words add to ``known`` and ``logs``."""
    spark = encoded.sparkSession
    class_of = np.full(TAIL + 1, REST, np.uint8)
    class_of[: head.n_core + 1] = core[:-1]
    rest = head.words[head.n_core :]
    place = {w: i for i, w in enumerate(rest, head.n_core + 1)}
    wanted = spark.createDataFrame([(w,) for w in rest], "word binary")
    for r in named.join(F.broadcast(wanted), "word", "left_semi").select("word", "cls").collect():
        class_of[place[bytes(r["word"])]] = r["cls"]
    shared = spark.sparkContext.broadcast(class_of)
    tail = encoded.select("uid", F.posexplode("tail_words").alias("i", "word")).join(named, "word", "left")
    found = tail.where("n is not null").groupBy("uid").agg(F.collect_list(F.struct("i", "n", "cls")).alias("found"))
    found = found.select("uid", F.col("found.i").alias("i"), F.col("found.n").alias("n"), F.col("found.cls").alias("cls"))
    joined = encoded.withColumn("n_tail", F.size("tail_words")).drop("tail_words").join(found, "uid", "left")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            classes, known, logs = [], [], []
            for units, at, n_tail, places, ns, cls in zip(frame["units"], frame["tail_at"], frame["n_tail"], frame["i"], frame["n"], frame["cls"], strict=True):
                units = np.frombuffer(units, "<u2")
                own, at = table[units], np.frombuffer(at, "<u4")
                extra, count = np.full(n_tail, REST, np.uint8), np.zeros(n_tail, np.int64)
                if places is not None:
                    extra[places], count[places] = cls, ns
                own[units == TAIL] = extra[at]
                count = count[at]
                classes.append(own.tobytes())
                known.append(int((count > 0).sum()))
                logs.append(float(np.log10(count + 1).sum()))
            out = frame[["doc_id", "held_out", "n_tokens"]].reset_index(drop=True)
            yield out.assign(known=frame["known"].to_numpy() + known, logs=frame["logs"].to_numpy() + logs, classes=classes)

    return joined.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, classes binary")


def _transitions(classed: DataFrame, s: Settings) -> np.ndarray:
    """N(class before, class) over the texts."""
    c = s.classes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(c * c, np.int64)
        for frame in _pieces(frames):
            whole = closed(*_flat(frame["classes"], "u1"))
            sums += np.bincount(_before(whole) * c + whole, minlength=c * c)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"pair": at, "n": sums[at]})

    out = np.zeros(c * c)
    for pair, n in classed.select("classes").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(c, c)


@dataclass(frozen=True)
class Model:
    """log10 of P(class | class before), of what divides the counts of a class, and of an unseen word after each class."""

    moves: np.ndarray
    sizes: np.ndarray
    unseen: np.ndarray

    @classmethod
    def of(cls, bigrams: np.ndarray, types: np.ndarray, s: Settings) -> Model:
        counts = bigrams.sum(0)
        share = counts + 1
        share[REST] = 0
        moves = (bigrams + s.smoothing * share / share.sum()) / (bigrams.sum(1, keepdims=True) + s.smoothing)
        sizes = counts + types + 1
        unseen = (moves[:, 2:] / sizes[2:]).sum(1)
        sizes[END] = 1  # the end is its class
        with np.errstate(divide="ignore"):
            return cls(np.log10(moves), np.log10(sizes), np.log10(unseen))

    def of_tokens(self, whole: np.ndarray) -> np.ndarray:
        """log10 probabilities of closed texts, but for the counts of their words."""
        before = _before(whole)
        return np.where(whole == REST, self.unseen[before], self.moves[before, whole] - self.sizes[whole])


def scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    learned = docs.where(remainder(F.col("doc_id"), s.folds) != s.held_out)
    vocabulary = written(word_counts(learned), "vocabulary", TEXT_BATCH)
    head = _head(vocabulary, learned.count(), s)
    dropped(vocabulary)
    encoded = written(_encoded(docs, head, s), "encoded", TEXT_BATCH)
    named, core = word_classes(encoded.where("not held_out"), head, s)
    classed = written(_classed(encoded, named, head, core, s), "classed", TEXT_BATCH)
    dropped(encoded)
    types = np.bincount(core[1:-1], minlength=s.classes).astype(float)
    for cls, n in named.groupBy("cls").count().collect():
        types[cls] += n
    dropped(named)
    model = Model.of(_transitions(classed.where("not held_out"), s), types, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            flat, lengths = _flat(frame["classes"], "u1")
            each = shared.value.of_tokens(closed(flat, lengths))
            sums = np.add.reduceat(each, np.cumsum(lengths + 1) - (lengths + 1)) if len(lengths) else each
            yield frame.drop(columns="classes").assign(score=frame["logs"] + sums)

    rows = classed.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double")
    end = float(np.log10(head.n_ends + 1))
    out = rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(head.n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + end - F.col("n_tokens") * head.floor).alias("base_score"),
        "score",
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
