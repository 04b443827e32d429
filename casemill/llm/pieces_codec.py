"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a vocabulary form an Aho-Corasick automaton.  One pass over a text
follows it; at each position the output links name every piece that ends there,
and each relaxes the best score of that position (Viterbi).  The best path is the
segmentation with the highest sum of piece scores.  Characters that no piece
covers become their UTF-8 bytes (byte fallback), or the unknown piece.

As no usual piece holds a space mark behind another character, every path breaks
before each run of space marks, and around each character that no piece holds.  The encoder checks this of its vocabulary and
then encodes such stretches and remembers them: the new ones of a batch of texts
walk the automaton together, character by character, as columns of an array
(:class:`Lockstep`).  With a vocabulary that breaks the rule, and for very long
stretches, it runs over the text by itself.  All ways give the same result.

Decoding joins the pieces, turns bytes into text, and takes the added space mark
off.  ``decode(encode(text)) == text`` for every text without the space mark
itself (U+2581); each such text decodes to spaces there, as in the format.

Cases: null text has null ids and decodes to null; empty text has no ids; ids
outside the vocabulary decode to nothing; very long texts are encoded whole, in
memory of the order of the text; only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: How far an unknown character is below the lowest score of a piece.
UNKNOWN_PENALTY = 10.0
#: Stretches that a worker remembers, twice: the newer, and the generation before it.
REMEMBERED = 150_000
#: Longest stretch that is remembered, and how many walk the automaton together.
KEPT_LENGTH, TOGETHER = 64, 16_384
#: Bytes of text that are encoded at once.
SLICE = 2_000_000


@dataclass(frozen=True)
class Limits:
    """What a codec may remember and hold at once.  A worker keeps most of its largest memory for the jobs that come
    after, so smaller limits leave more of an executor to the other steps of a chain, for some more CPU time."""

    remembered: int = REMEMBERED
    together: int = TOGETHER
    slice: int = SLICE


#: Of :func:`encoded`: on 16,026 texts of check_l 144 MB of a worker at most instead of 237, for a fifth more CPU time.
LEAN = Limits(50_000, 4_096, 500_000)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores by id; usable: those that encoding may emit; byte_ids: byte -> id, or empty."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Reads a SentencePiece model file; only on the driver."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = tuple(sp.id_to_piece(i) for i in range(n))
        bytes_of = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usable = tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n))
        return cls(pieces, tuple(sp.get_score(i) for i in range(n)), usable, tuple(bytes_of[b] for b in range(256)) if len(bytes_of) == 256 else (), sp.unk_id())


class Automaton:
    """Aho-Corasick over pieces: goto and failure links, and output links to the pieces that end at a state."""

    def __init__(self, pieces: Sequence[tuple[str, int, float]]):
        self.go: list[dict[str, int]] = [{}]
        self.fail, self.ends, self.link = [0], [-1], [0]
        self.length, self.score = {}, {}
        for piece, i, score in pieces:
            state = 0
            for c in piece:
                if c not in self.go[state]:
                    self.go[state][c] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    self.ends.append(-1)
                    self.link.append(0)
                state = self.go[state][c]
            self.ends[state] = i
            self.length[i], self.score[i] = len(piece), score
        queue = deque(self.go[0].values())
        self.order = [0]
        while queue:
            state = queue.popleft()
            self.order.append(state)
            for c, nxt in self.go[state].items():
                back = self.fail[state]
                while back and c not in self.go[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.go[back].get(c, 0) if self.go[back].get(c, 0) != nxt else 0
                queue.append(nxt)
            back = self.fail[state]
            self.link[state] = back if self.ends[back] >= 0 else self.link[back]
        self.outs = self.outputs()

    def outputs(self) -> list[tuple[bool, tuple[tuple[int, float, int], ...]]]:
        """For each state, by its output links: whether a one-character piece ends there, and (length, score, id) of all
        pieces that do, longest first."""
        out: list[tuple[tuple[int, float, int], ...] | None] = [None] * len(self.go)
        for state in self.order:
            own = ((self.length[self.ends[state]], self.score[self.ends[state]], self.ends[state]),) if self.ends[state] >= 0 else ()
            out[state] = own + (out[self.link[state]] if self.link[state] else ())
        return [(bool(x) and x[-1][0] == 1, x) for x in out]

    def best_path(self, text: str, unknown_score: float) -> list[tuple[int, int, int]]:
        """(id or -1, start, end) of the best segmentation; of equal sums, the one with the earliest start."""
        go, fail, outs = self.go, self.fail, self.outs
        best, came, state = [0.0], [None], 0
        for end, c in enumerate(text, 1):
            step = go[state].get(c)
            while step is None:
                if not state:
                    step = 0
                    break
                state = fail[state]
                step = go[state].get(c)
            state = step
            single, here = outs[state]
            top = -1e300 if single else best[end - 1] + unknown_score
            how = (-1, end - 1)
            # Longest piece first, so that of equal sums the earliest start wins.
            for k, score, i in here:
                value = best[end - k] + score
                if value > top or (value == top and how[0] < 0):
                    top, how = value, (i, end - k)
            best.append(top)
            came.append(how)
        path, end = [], len(text)
        while end:
            i, start = came[end]
            path.append((i, start, end))
            end = start
        return path[::-1]


class Lockstep:
    """The same automaton as arrays: many short stretches take each step of the walk and of the Viterbi pass together.
    A space counts as the space mark.

    Edges lie in an open hash table, keyed by state and character.  Each state lists its outputs longest first and
    then, if no one-character piece ends there, the unknown character; the first of equal sums wins, as in
    :meth:`Automaton.best_path`.
    """

    def __init__(self, automaton: Automaton, unknown_score: float):
        go = automaton.go
        chars = sorted({c for edges in go for c in edges})
        self.width = len(chars) + 1
        #: Code point -> number of the character; the last number stands for all that no piece has.
        self.number = np.full(0x110000, len(chars), np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(len(chars))
        self.number[ord(" ")] = self.number[ord(MARK)]
        keys = np.array([s * self.width + int(self.number[ord(c)]) for s, edges in enumerate(go) for c in edges], np.int64)
        targets = np.array([t for edges in go for t in edges.values()], np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.targets = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        place = self._place(keys)
        while len(left):
            free = self.keys[place[left]] < 0
            self.keys[place[left[free]]] = keys[left[free]]  # of those that meet in a free place, one stays
            done = self.keys[place[left]] == keys[left]
            self.targets[place[left[done]]] = targets[left[done]]
            left = left[~done]
            place[left] = (place[left] + 1) & (len(self.keys) - 1)
        self.fail = np.array(automaton.fail, np.int32)
        each = [own if single else (*own, (1, unknown_score, -1)) for single, own in automaton.outs]
        self.n_out = np.array([len(x) for x in each], np.int64)
        self.first = np.cumsum(self.n_out) - self.n_out
        flat = [o for x in each for o in x]
        self.length, self.score, self.ids = (np.array([o[i] for o in flat], kind) for i, kind in enumerate((np.int32, np.float64, np.int32)))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state after each character: along an edge, or along failure links until there is one."""
        out = np.zeros(len(states), np.int32)
        rows, at = np.arange(len(states)), states.astype(np.int64)
        while len(rows):
            keys = at * self.width + chars[rows]
            place = self._place(keys)
            seen = self.keys[place]
            while (other := (seen != keys) & (seen >= 0)).any():
                place[other] = (place[other] + 1) & (len(self.keys) - 1)
                seen[other] = self.keys[place[other]]
            hit = seen == keys
            out[rows[hit]] = self.targets[place[hit]]
            more = ~hit & (at > 0)
            rows, at = rows[more], self.fail[at[more]].astype(np.int64)
        return out

    def best_paths(self, stretches: Sequence[str]) -> list[bytes | None]:
        """For each stretch its ids as little-endian 32-bit numbers, or None if it holds an unknown character."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        n, longest = len(order), int(sizes[0]) if len(order) else 0
        points = self.number[np.frombuffer("".join([stretches[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")]
        begin = np.cumsum(sizes) - sizes
        best, came = np.zeros((longest + 1, n)), np.zeros((longest + 1, n), np.int64)
        state = np.zeros(n, np.int32)
        for end in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -end, side="right"))
            state = self.step(state[:live], points[begin[:live] + end - 1])
            count = self.n_out[state]
            head = np.cumsum(count) - count
            row = np.repeat(np.arange(live), count)
            out = np.arange(len(row)) + np.repeat(self.first[state] - head, count)
            value = best[end - self.length[out], row] + self.score[out]
            top = np.maximum.reduceat(value, head)
            best[end, :live] = top
            first = np.flatnonzero(value == top[row])[::-1]
            came[end, row[first]] = out[first]  # backwards, so that the first of equal sums is written last
        ids, end, rows = np.full((n, longest + 1), -2, np.int32), sizes.copy(), np.arange(n)
        while len(rows):
            out = came[end, rows]
            ids[rows, end] = self.ids[out]
            end = end - self.length[out]
            rows, end = rows[end > 0], end[end > 0]
        known = ~(ids == -1).any(axis=1)
        given = ids >= 0
        ends = np.cumsum(given.sum(axis=1)) * 4
        raw = ids[given].astype("<i4").tobytes()
        found: list[bytes | None] = [None] * n
        start = 0
        for i, stop, ok in zip(order.tolist(), ends.tolist(), known.tolist(), strict=True):
            if ok:
                found[i] = raw[start:stop]
            start = stop
        return found


class Codec:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    def __init__(self, vocabulary: Vocabulary, limits: Limits = Limits()):
        v = self.vocabulary = vocabulary
        self.limits = limits
        usable = [(p, i, s) for i, (p, s, ok) in enumerate(zip(v.pieces, v.scores, v.usable, strict=True)) if ok and p]
        self.automaton = Automaton(usable)
        self.unknown_score = min((s for _, _, s in usable), default=0.0) - UNKNOWN_PENALTY
        self.together = Lockstep(self.automaton, self.unknown_score)
        self.splits = not any(MARK in p.lstrip(MARK) or " " in p for p, _, _ in usable)
        # Stretches are cut from plain text, where spaces stand for space marks.  A character that no piece holds is a
        # stretch of its own: no path goes across it.
        held = re.escape("".join(sorted({c for p, _, _ in usable for c in p} - {MARK, " "})))
        self.stretch = re.compile(f" *[{held}]+| +|(?s:.)" if held else " +|(?s:.)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = [p.encode() for p in v.pieces]
        special = [not ok for ok in v.usable]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i], special[i] = bytes([b]), False
        for i, s in enumerate(special):
            if s:
                self.bytes_of[i] = b""

    def _stretch_ids(self, stretch: str) -> bytes:
        ids: list[int] = []
        stretch = stretch.replace(" ", MARK)
        for i, start, end in self.automaton.best_path(stretch, self.unknown_score):
            if i >= 0:
                ids.append(i)
            elif self.vocabulary.byte_ids:
                ids.extend(self.vocabulary.byte_ids[b] for b in stretch[start:end].encode("utf-8", "replace"))
            else:
                ids.append(self.vocabulary.unknown)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _learn(self, stretches: set[str]) -> None:
        """Remembers the ids of those stretches that it doesn't know and that are not too long to be kept."""
        if len(self.known) >= self.limits.remembered:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = stretches.difference(known)
        again = new.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        fresh = [x for x in new.difference(again) if len(x) <= KEPT_LENGTH]
        fresh.sort(key=len)
        for at in range(0, len(fresh), self.limits.together):
            part = fresh[at : at + self.limits.together]
            for x, ids in zip(part, self.together.best_paths(part), strict=True):
                known[x] = self._stretch_ids(x) if ids is None else ids

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """For each text the ids as little-endian 32-bit numbers; memory is of the order of all texts together."""
        # The space mark itself counts as a space, and one is added at the start.
        begun = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        if not self.splits:
            return [self._stretch_ids(t) if t else b"" for t in begun]
        parts = [self.stretch.findall(t) for t in begun]
        self._learn(set().union(*parts))
        known, own, out = self.known, self._stretch_ids, []
        for p in parts:
            try:
                out.append(b"".join(map(known.__getitem__, p)))
            except KeyError:  # a very long stretch
                out.append(b"".join([known[x] if len(x) <= KEPT_LENGTH else own(x) for x in p]))
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of one text as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4")

    def decode(self, ids: Sequence[int]) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < n)].tolist()
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def codec_of(broadcast) -> Codec:  # noqa: ANN001
    """This worker's codec for a broadcast vocabulary."""
    vocabulary = broadcast.value
    key = id(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Views of a batch with about ``size`` bytes of text each (one row at least)."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // size, prepend=-1))
    for first, last in zip(starts, [*starts[1:], len(sizes)][: len(starts)], strict=True):
        yield batch.slice(first, last - first)


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether decoding gives the text back.

    The vocabulary is read on the driver and broadcast: its size is that of the
    model file, whatever the corpus.  Each task builds its codec (0.4 s for 32,000 pieces).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, LEAN)  # of this task alone: an idle worker would keep it from the jobs that follow
        for batch in batches:
            for part in _slices(batch, "text", LEAN.slice):
                texts = part.column("text").to_pylist()
                ids = codec.encode_all([t or "" for t in texts])
                ok = [None if t is None else codec.decode(np.frombuffer(x, "<i4")) == t.replace(MARK, " ") for t, x in zip(texts, ids, strict=True)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(ends, values, mask=pa.array([t is None for t in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(n), pa.array(ok, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens long, round_trip boolean")


def decoded(frame: DataFrame, model_file: str, ids: str = "token_ids") -> DataFrame:
    """doc_id and text of rows with token ids."""
    shared = frame.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    rows = frame.select("doc_id", F.col(ids).alias("token_ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(shared)
        for part in frames:
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "text": [None if x is None else codec.decode(x) for x in part["token_ids"]]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
