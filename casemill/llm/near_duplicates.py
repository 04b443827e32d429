"""MinHash near-duplicates with SuperMinHash signatures.

1. Every text becomes its set of 64-bit shingle hashes; texts with one and the same
   set (128-bit digest) are one class, with a number of its own, and only its smallest
   row is compared.
2. SuperMinHash: each element ranks the ``Settings.hashes`` positions by a random
   permutation of its own, drawn place by place; a position's value is the least
   place + uniform number over all elements.  Ranks are drawn level by level for
   all elements at once, and stop early as soon as every position has a value below
   the next level, as later levels cannot lower it.
3. Bands of signature values deal classes into buckets.  In each bucket all members
   are paired with one leader; two rounds pick leaders by different orders, and a
   round only looks at buckets whose members are not all of one group yet.
4. Pairs are verified on the full sets; verified links join groups by union-find
   (hooking to smaller roots and pointer jumping, in Spark).
5. Buckets that still hold several groups are worked off exactly: members outside
   the bucket's largest group are compared with all members on full sets, in blocks;
   of the links that hold, one for each member and other group comes out.  Of buckets
   with the very same members, in several bands, one is worked off.  No bucket is cut
   or capped; a bucket of n members that are all unlike costs n * n / 256 sets.

Whole texts are shuffled only where a sieve (``shared.sieved``) says that a join by their
row's key may find something.

A pair at the threshold is missed only if no band agrees, with a chance below
1e-6 at the defaults.  Nothing but counts reaches the driver.

Cases: null, empty and blank texts have empty sets and are linked with nothing;
texts with fewer words than a shingle have the whole sequence as one shingle;
repeated rows and null ids are members of the same class (a null id is never a
representative if another id is there; the largest long counts as null); one id with
several texts is a row of its own for each; an empty table gives no rows; only doc_id
and text are read, and further columns of :func:`deduplicated` may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import TEXT_BATCH, WORD, dropped, free_name, sieved, small, written

#: Stands for a null id while the smallest id of a group is found.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """Jaccard similarity of at least percent / 100 over shingles of ``words`` words."""

    words: int = 5
    percent: int = 80
    hashes: int = 120
    rows: int = 4
    seed: int = 1
    rounds: int = 2
    block: int = 256

    @property
    def bands(self) -> int:
        return self.hashes // self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes.

    ``bytes.lower`` changes A-Z alone, and ``bytes.split`` parts at 0x20 and 0x09-0x0D alone.
    """

    def __init__(self, words: int):
        self.n = words

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        k = min(self.n, len(found))
        out = np.zeros(len(found) - k + 1, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(found) - k + 1 + i])
        out += np.uint64(k)
        out.sort()
        first = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=first[1:])
        return out[first]


def super_min_hash(elements: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """m values of 64 bits: the level in the upper 16, the uniform number below.

    Level j draws for each element a place p >= j of its permutation and a uniform
    number; the position that stands at p gets the least (j, number).
    """
    best = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n = len(elements)
    if not n:
        return best
    state = _mix(elements ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    places = None
    rows = np.arange(n)
    for j in range(m):
        draw = _mix(state + np.uint64((j + 1) * 0xD1B54A32D192ED03 % 2**64))
        p = j + ((draw & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        value = (draw >> np.uint64(16)) | np.uint64(j << 48)
        if j == 0:
            position = p
        else:
            if places is None:
                places = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                places[rows, first] = 0
                places[:, 0] = first
            position = places[rows, p]
            places[rows, p] = places[:, j]
        if j == 0:
            first = p
        np.minimum.at(best, position, value)
        if (best >> np.uint64(48)).max() <= j:
            break
    return best


def band_keys(signature: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = signature[: s.bands * s.rows].reshape(s.bands, s.rows)
    out = np.arange(1, s.bands + 1, dtype=np.uint64)
    for i in range(s.rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def row_key() -> tuple[Column, Column]:
    """What tells rows apart: the id (null as ``NO_ID``), and a hash of 128 bits of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.md5("text")


def signed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (a digest of the set; null for an empty set) and bands.

    Copies have the same bands as their class.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(s.words)
        for frame in frames:
            sizes, keys, bands = [], [], []
            for text in frame["text"]:
                x = shingle(text)
                sizes.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                bands.append(band_keys(super_min_hash(x, s.hashes, s.seed), s) if len(x) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "text_hash": frame["text_hash"], "n_shingles": sizes, "set_key": keys, "bands": bands})

    rows = docs.select("doc_id", "text", row_key()[1].alias("text_hash"))
    return rows.mapInPandas(run, f"doc_id {kind}, text_hash string, n_shingles long, set_key binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets pass; ``texts`` has cls and text of each class."""
    first = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(s.words)
        last: tuple[object, np.ndarray] = (None, np.empty(0, np.uint64))
        for frame in frames:
            keep = []
            for b, ta, tb in zip(frame["b"], frame["ta"], frame["tb"], strict=True):
                if last[0] != b:
                    last = (b, shingle(tb))
                x, y = shingle(ta), last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= s.percent * (len(x) + len(y) - common))
            yield frame.loc[keep, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) for each node of ``nodes``: the smallest node it is linked with, directly or not.

    Union-find in rounds: every root hooks to the smallest root among its links,
    then pointers jump until they rest; links inside a group go.  Written tables cut
    the lineage; only counts reach the driver.
    """
    root = written(nodes.select("node", F.col("node").alias("root")), "roots")
    edges = written(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        hooks = written(down, "hooks")
        while True:
            jump = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.node"), "left")
            moved = written(jump.select(F.col("x.node").alias("node"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("jumped")), "hooks")
            dropped(hooks)
            hooks = moved.select("node", "to")
            hooks._casemill_path = moved._casemill_path
            if not moved.where("jumped").limit(1).count():
                break
        new = root.join(hooks.withColumnsRenamed({"node": "root", "to": "next"}), "root", "left")
        next_root = written(new.select("node", F.coalesce("next", "root").alias("root")), "roots")
        at = lambda side: edges.join(hooks, edges[side] == hooks["node"], "left")
        one = at("a").select(F.coalesce("to", "a").alias("a"), "b")
        two = one.join(hooks, one["b"] == hooks["node"], "left").select("a", F.coalesce("to", "b").alias("b"))
        next_edges = written(two.where("a != b").distinct(), "edges")
        for old in (root, edges, hooks):
            dropped(old)
        root, edges = next_root, next_edges
    dropped(edges)
    return root


def _leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of a bucket with one leader; members are (band, cls, root)."""
    order = F.col("cls") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    lead = members.groupBy("band").agg(
        F.min_by(F.struct("cls", "root"), F.struct(order, "cls")).alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    # Written, so that the join is planned by its own size, and a hot bucket can be split.
    mixed = written(lead.where("low != high").select("band", F.col("lead.cls").alias("b"), F.col("lead.root").alias("b_root")), "leaders")
    pairs = members.join(small(mixed), "band").where("root != b_root")
    return pairs.select(F.col("cls").alias("a"), "b").distinct()


def _sets(texts: DataFrame, s: Settings) -> DataFrame:
    """cls and the hashes of its set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(s.words)
        for frame in frames:
            sets = [shingle(t).astype("<u8").tobytes() for t in frame["text"]]
            yield pd.DataFrame({"cls": frame["cls"], "elements": sets})

    return texts.select("cls", "text").mapInPandas(run, "cls long, elements binary")


def _rest_pairs(members: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Verified links across groups of one bucket that leaders left open.

    Members outside the largest group of their bucket meet all members, in blocks of
    ``s.block``; a block pair is one task's work, whatever the size of the bucket.
    Full sets are compared inside the block, and for each member and other group one link
    at most comes out, so the result is no larger than members and blocks.
    """
    # 128 bits that tell sets of members apart, in any order.
    prints = [F.bit_xor(F.xxhash64("cls", F.lit(seed))).alias(f"print{seed}") for seed in (0, 1)]
    groups = members.groupBy("band", "root").agg(F.count("*").alias("count"), *prints)
    big = groups.groupBy("band").agg(
        F.sum("count").alias("n"), (F.sum("count") - F.max("count")).alias("n_small"), F.max_by("root", F.struct("count", "root")).alias("big"),
        F.bit_xor("print0").alias("print0"), F.bit_xor("print1").alias("print1"),
    )
    once = big.where("n_small > 0").groupBy("n", "n_small", "big", "print0", "print1").agg(F.min("band").alias("band"))
    big = small(written(once.select("band", "n", "n_small", "big"), "open"))
    open_ = written(members.join(big, "band").withColumn("small", F.col("root") != F.col("big")), "open-buckets")
    held = written(_sets(texts.join(open_.select("cls").distinct(), "cls", "left_semi"), s), "sets", TEXT_BATCH)
    sides = open_.join(held, "cls")
    of = lambda n: F.greatest(F.ceil(F.col(n) / s.block).cast("int"), F.lit(1))
    place = lambda n: F.pmod(F.xxhash64("cls", "band"), of(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    columns = [F.col(c).alias(c) for c in ("cls", "root", "elements")]  # aliases, as both sides come from one table
    band = F.col("band").alias("band")
    left = sides.where("small").select(band, place("n_small").alias("i"), every("n").alias("j"), *columns)
    right = sides.select(band, every("n_small").alias("i"), place("n").alias("j"), *columns)

    def run(_key, lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        out = []
        if len(lefts) and len(rights):
            sets = [np.frombuffer(x, "<u8") for x in rights["elements"]]
            sizes = np.array([len(x) for x in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            other, root = rights["cls"].to_numpy(), rights["root"].to_numpy()
            for cls, own, raw in zip(lefts["cls"], lefts["root"], lefts["elements"], strict=True):
                x = np.frombuffer(raw, "<u8")
                first, last = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                n = last - first
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                like = np.flatnonzero((100 * common >= s.percent * (len(x) + sizes - common)) & (root != own))
                for group in np.unique(root[like]):
                    y = other[like[root[like] == group][0]]
                    out.append((max(cls, y), min(cls, y)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ("band", "i", "j")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "a long, b long")
    return pairs.distinct()


def _without_bands(table: DataFrame, name: str) -> DataFrame:
    """A written table anew without its bands; the old one is deleted."""
    slim = written(table.drop("bands"), name)
    dropped(table)
    return slim


def _grouped(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, low, text_hash, n_shingles and rep (low and text_hash of the first row of the group; null without words)."""
    low = row_key()[0]
    rows = written(signed(docs, s), "signed", TEXT_BATCH)
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(low.alias("low"), "text_hash")).alias("rep"), F.first("bands").alias("bands"))
    reps = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    banded = reps.select("cls", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").count().where("count > 1").select("band")
    members = written(banded.join(shared, "band", "left_semi").select("band", "cls"), "buckets")
    # Nothing reads the bands any more, which are most of both tables.
    rows, reps = _without_bands(rows, "rows"), _without_bands(reps, "classes")
    nodes = written(members.select(F.col("cls").alias("node")).distinct(), "nodes")
    wanted = reps.join(nodes, F.col("cls") == F.col("node"), "left_semi").select("cls", F.col("rep.low").alias("low"), F.col("rep.text_hash").alias("text_hash"))
    wanted = written(wanted, "wanted")
    keyed = docs.select(low.alias("low"), row_key()[1].alias("text_hash"), "text")
    near, _ = sieved(keyed, wanted, ["low", "text_hash"])
    # A class has one low and text_hash, and they have one class, so texts stay where the join has brought them.
    texts = written(near.join(wanted, ["low", "text_hash"]).dropDuplicates(["low", "text_hash"]).select("cls", "text"), "candidate-texts")
    roots = written(nodes.select("node", F.col("node").alias("root")), "roots")
    links: list[DataFrame] = []
    for turn in range(s.rounds + 1):
        grouped = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls")
        pairs = written(_leader_pairs(grouped, turn) if turn < s.rounds else _rest_pairs(grouped, texts, s), "pairs")
        if pairs.isEmpty():
            if turn < s.rounds:
                break
            continue
        links.append(written(_verified(small(pairs), texts, s), "links", TEXT_BATCH) if turn < s.rounds else pairs)
        old = roots
        roots = components(reduce(DataFrame.unionAll, links), nodes)
        dropped(old)
        if turn < s.rounds:
            dropped(pairs)
    for old in (texts, members):
        dropped(old)
    # Only classes that share a bucket can be in a group of several; a table of its own, so that a hot root can be split.
    linked = reps.select("cls", "rep", "set_key").join(roots.select(F.col("node").alias("cls"), "root"), "cls")
    first = written(linked.groupBy("root").agg(F.min("rep").alias("first")), "firsts")
    named = written(linked.join(small(first), "root").select("set_key", F.col("first").alias("rep")), "named")
    alone = reps.join(nodes, F.col("cls") == F.col("node"), "left_anti").select("set_key", "rep")
    own = rows.where("set_key is not null").join(named.unionByName(alone), "set_key")
    empty = rows.where("set_key is null").withColumn("rep", F.lit(None).cast(own.schema["rep"].dataType))
    return own.select("doc_id", low.alias("low"), "text_hash", "n_shingles", "rep").unionByName(empty.select("doc_id", low.alias("low"), "text_hash", "n_shingles", "rep"))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group) and kept, for each row of ``docs``.

    ``docs`` has integer doc_id and text, and is a table scan.  A null id stands
    for itself: its component_id is null unless the group has an id.
    """
    found = _grouped(docs, s)
    component = F.nullif(F.coalesce("rep.low", "low"), F.lit(NO_ID))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of each group of near-duplicates, with the same columns; rows without words stay.

    It is the row with the smallest id (null last) and then the smallest hash of the text; of rows that repeat both,
    any one stays.
    """
    found = written(_grouped(docs, s).where("rep is not null"), "grouped")
    first = (F.col("rep.low") == F.col("low")) & (F.col("rep.text_hash") == F.col("text_hash"))
    lost = written(found.where(~first).select("low", "text_hash").distinct(), "lost")
    repeated = written(found.where(first).groupBy("low", "text_hash").count().where("count > 1").select("low", "text_hash"), "repeated")
    low, text_hash = free_name(docs, "nd_low"), free_name(docs, "nd_text_hash")
    keyed = docs.withColumns(dict(zip((low, text_hash), row_key(), strict=True)))
    named = lambda df: small(df).withColumnsRenamed({"low": low, "text_hash": text_hash})
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    touched = written(lost.unionByName(repeated).withColumnsRenamed({"low": low, "text_hash": text_hash}), "touched")
    keyed, plain = sieved(keyed, touched, [low, text_hash])
    # A row without words can have the key of no other row, as its text is another.
    kept = keyed.join(named(lost), [low, text_hash], "left_anti")
    if repeated.isEmpty():
        return plain.unionByName(kept).select(*docs.columns)
    once = kept.where(worded).join(named(repeated), [low, text_hash], "left_semi").dropDuplicates([low, text_hash])
    rest = kept.where(worded).join(named(repeated), [low, text_hash], "left_anti").unionByName(kept.where(~worded))
    return plain.unionByName(rest).unionByName(once).select(*docs.columns)
