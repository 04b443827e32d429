"""Token-ID output in training order.

Texts become token ids, an end token closes each text, and ids are cut into
sequences of a fixed length (the last of a text is padded with the end token).
Every sequence gets a global slot: its running number under a keyed Feistel
permutation of [0, number of sequences), with cycle-walking for numbers that are
no power of four.  Sequences are then dealt out by ranges of slots, so that each
shard is a run of slots with a fixed stride: slot s lies at byte
(s - first slot of its shard) * stride, and a reader may stop and go on anywhere.

Running numbers follow a keyed hash of id and text, so that the order depends on
the rows alone, not on files, tasks or settings: encoded texts are dealt out by
ranges of that hash (of equal width, as hashes are uniform), sorted and numbered in
each range, and written to the shared folder; a range starts at the sum of the
ranges before it.  Only one sum for each range reaches the driver.

Cases: null text is empty text, and an empty text is one sequence of end tokens
with n_tokens 1; repeated rows get slots each, rows of one id and different texts
lie in different ranges; an empty table gives no rows; only doc_id and text are
read; a very long text is many sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces_codec import Vocabulary, _slices, codec_of
from .shared import written


@dataclass(frozen=True)
class Settings:
    model_file: str
    length: int = 256
    end_token: int = 2
    key: int = 0x5EED
    rounds: int = 6
    shard_bytes: int = 64 << 20

    @property
    def stride(self) -> int:
        """Bytes of a sequence: two for each id, and the line break that the text sink adds."""
        return 2 * self.length + 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, total: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of [0, total): Feistel over 2k bits, walked on while the value is outside."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (_mix(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (outside := out >= np.uint64(total)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _encoded(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, ids (compressed), n (sequences), the key of the order, and the range in which it lies."""
    vocabulary = Vocabulary.load(s.model_file)
    if len(vocabulary.pieces) > 65536:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.lit(s.key), F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([s.end_token], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, pack = codec_of(shared), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = [np.frombuffer(x, "<i4").astype("<u2").tobytes() + end for x in codec.encode_all(part.column("text").to_pylist())]
                n = pa.array([-(-len(x) // (2 * s.length)) for x in ids], pa.int64())
                packed = pa.array([pack(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), packed, n], ["doc_id", "key", "ids", "n"])

    return rows.mapInArrow(run, f"doc_id {kind}, key long, ids binary, n long")


def _numbered(encoded: DataFrame, ranges: int) -> DataFrame:
    """Adds the range of each row, and the number of sequences of its range before it."""
    place = F.shiftright((F.shiftright("key", 33) + (1 << 30)) * ranges, 31)
    dealt = encoded.withColumn("range", place.cast("int")).repartitionById(ranges, F.col("range")).sortWithinPartitions("key", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = np.asarray(batch.column("n"), np.int64)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "first"])

    return dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", first long")


def in_training_order(docs: DataFrame, s: Settings) -> DataFrame:
    """shard, slot, byte_offset, doc_id, part, n_tokens and payload (ids as little-endian 16-bit numbers).

    Partition i of the result holds shard i, sorted by slot.  Neither slots nor shards depend on the session's settings.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = written(_numbered(_encoded(docs, s), ranges), "token-ids")
    sums = sorted(tuple(r) for r in encoded.groupBy("range").agg(F.sum("n")).collect())
    offsets, total = {}, 0
    for place, n in sums:
        offsets[place], total = total, total + n
    held = spark.sparkContext.broadcast(offsets)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, unpack = 2 * s.length, zstandard.ZstdDecompressor().decompress
        fill = np.array([s.end_token], "<u2").tobytes()
        for batch in batches:
            for part in _slices(batch, "ids"):
                n = np.asarray(part.column("n"), np.int64)
                starts = np.asarray(part.column("first"), np.int64) + np.array([held.value[r] for r in part.column("range").to_pylist()], np.int64)
                whole, sizes = [], []
                for raw, k in zip(part.column("ids").to_pylist(), n.tolist(), strict=True):
                    raw = unpack(raw)
                    sizes += [s.length] * (k - 1) + [len(raw) // 2 - (k - 1) * s.length]
                    whole += [raw, fill * (k * s.length - len(raw) // 2)]
                owners = np.repeat(np.arange(len(n)), n)
                numbers = np.arange(len(owners)) - np.repeat(np.cumsum(n) - n, n)
                payload = pa.Array.from_buffers(pa.binary(step), len(owners), [None, pa.py_buffer(b"".join(whole))]).cast(pa.binary())
                slots = permuted(starts[owners] + numbers, total, s.key, s.rounds)
                columns = [pa.array(slots), part.column("doc_id").take(pa.array(owners)), pa.array(numbers.astype(np.int32)), pa.array(sizes, pa.int32()), payload]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "doc_id", "part", "n_tokens", "payload"])

    rows = encoded.mapInArrow(cut, f"slot long, doc_id {kind}, part int, n_tokens int, payload binary")
    shards = max(1, -(-total * s.stride // s.shard_bytes))
    span = max(1, -(-total // shards))
    shard = F.floor(F.col("slot") / span).cast("int")
    return (
        rows.withColumn("shard", shard)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("slot")
        .select("shard", "slot", ((F.col("slot") - F.col("shard") * span) * s.stride).alias("byte_offset"), "doc_id", "part", "n_tokens", "payload")
    )


def write_shards(ordered: DataFrame, path: str) -> None:
    """Binary shards through Spark's committed text sink: one file for each shard, a line break after each sequence."""
    ordered.select(F.col("payload").cast("string").alias("value")).write.mode("errorifexists").text(path)


def read_slots(shard: bytes, first: int, n: int, s: Settings) -> np.ndarray:
    """n sequences from the first-th of a shard's bytes."""
    raw = np.frombuffer(shard[first * s.stride : (first + n) * s.stride], np.uint8).reshape(n, s.stride)
    return raw[:, :-1].copy().view("<u2")
