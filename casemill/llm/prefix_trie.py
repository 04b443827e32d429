"""A trie of conversation prefixes, merged family by family.

Conversations of one hundred ids are a family; its base is the conversation whose id is
the hundred.  A family's turns come to one task as digests (never texts), are rebuilt
with the base's first turns, and become a small trie of prefixes.  Only the nodes of
those tries are shuffled then: equal prefixes of all families are one global node.

Sums over subtrees need no walk by levels.  Each global node has one owner, the family
of its smallest member; that family also holds all of the node's ancestors.  So every
family adds what its own nodes contribute to their ancestors in its small trie, and the
families' sums are added by node.

Digests are 128 bits of BLAKE2b or SHA-256, chained from the root, so equal digests mean
equal prefixes.

Hot nodes: equal nodes are combined by partial aggregates, so a first turn that a third of
all conversations share costs one row for each task.  The children of such a node find its
smallest member by a broadcast of the nodes with very many children, if these are counted
as few, and else by a join that adaptive execution splits.  The ids that end at one node
are sorted by ranges, joined to texts of bounded length there, and digested as a stream.
A family is at most 199 conversations; a task holds a few hundred bytes for each of its turns.

Cases: rows without conv_id belong to no conversation and make no node; a null role or text
is empty; turns of one number (null first) are ordered by digest, so that repeated rows are
turns that follow each other; a base that is absent gives no turns; conversations that end
up without turns end at the root; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, small, written

ROOT = b"\0" * 16


@dataclass(frozen=True)
class Settings:
    family: int = 100
    #: The base lends its first crc32(conv_id) mod ``lends`` turns.
    lends: int = 6
    #: Nodes with more children than this are looked up apart.
    hot: int = 10_000
    #: Longest text of joined ids that one row holds, in characters.
    chunk: int = 1 << 20


NODES = "family long, node binary, parent binary, depth long, chars long, members long, smallest long, inner boolean, ends array<long>"
SUMS = "node binary, leaves long, saved long, children long"


def turns(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """family, conv_id, place of the turn, digest of role and text, code points of the text; native, one pass."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % s.family).cast("long").alias("family"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.char_length(part("role")).cast("string"), F.lit(":"), part("role"), part("text")), 256), 1, 32)).alias("digest"),
        F.char_length(part("text")).cast("long").alias("chars"),
        (F.crc32(F.col("conv_id").cast("string")) % s.lends).cast("int").alias("lent"),
    )


def _nothing(schema: str) -> pd.DataFrame:
    return pd.DataFrame({field.split()[0]: [] for field in schema.split(", ")})


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["conv_id", "numbered", "turn", "digest"], kind="stable")


def _family_trie(base: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one family; a parent stands before its children."""
    if own.empty:
        return _nothing(NODES)
    base, own = _in_order(base), _in_order(own)
    lend = list(zip(map(bytes, base["digest"]), base["chars"].tolist(), strict=True))
    said = list(zip(map(bytes, own["digest"]), own["chars"].tolist(), strict=True))
    convs, lent = own["conv_id"].to_numpy(), own["lent"].to_numpy()
    starts = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
    family = int(own["family"].iloc[0])
    place = {ROOT: 0}
    node, parent, depth, chars, members, smallest, inner, ends = [ROOT], [None], [0], [0], [0], [int(convs[0])], [False], [[]]
    for begin, end in zip(starts, starts[1:], strict=False):
        conv, h = int(convs[begin]), int(lent[begin])
        at, here = 0, ROOT
        members[0] += 1
        for turn, n in [*lend[:h], *said[begin:end][h:]]:
            above, here = here, hashlib.blake2b(here + turn, digest_size=16).digest()
            inner[at] = True
            if here not in place:
                place[here] = len(node)
                node.append(here), parent.append(above), depth.append(depth[at] + 1), chars.append(n), members.append(0), smallest.append(conv), inner.append(False), ends.append([])
            at = place[here]
            members[at] += 1
        ends[at].append(conv)
    return pd.DataFrame({"family": family, "node": node, "parent": parent, "depth": depth, "chars": chars, "members": members, "smallest": smallest, "inner": inner, "ends": ends})


def family_nodes(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The nodes of every family's trie, with the ids that end at each."""
    own = turns(conversations, s)
    base = own.where(F.col("conv_id") == F.col("family"))
    return base.groupBy("family").cogroup(own.groupBy("family")).applyInPandas(_family_trie, NODES)


def _family_sums(nodes: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
    """What the nodes that this family owns add to each node of its trie."""
    if nodes.empty:
        return _nothing(SUMS)
    nodes = nodes.sort_values("depth", kind="stable")
    names, above = [bytes(x) for x in nodes["node"]], [None if x is None else bytes(x) for x in nodes["parent"]]
    place = {x: i for i, x in enumerate(names)}
    leaves, saved, children = (np.zeros(len(names), np.int64) for _ in range(3))
    mine = np.zeros(len(names), bool)
    for name, inner, members, chars in zip(owned["node"], owned["inner"], owned["members"], owned["chars"], strict=True):
        i = place[bytes(name)]
        mine[i], leaves[i], saved[i] = True, not inner, (members - 1) * chars
    for i in range(len(names) - 1, 0, -1):
        up = place[above[i]]
        leaves[up] += leaves[i]
        saved[up] += saved[i]
        children[up] += mine[i]
    adds = (leaves != 0) | (saved != 0) | (children != 0)
    return pd.DataFrame({"node": [x for x, a in zip(names, adds, strict=True) if a], "leaves": leaves[adds], "saved": saved[adds], "children": children[adds]})


def _joined_ids(longest: int):
    """Sorted (node, conv_id) rows as rows (node, first, ids), whose texts are at most some ``longest`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, begin = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or names[i] != names[begin] or (i - begin) * 21 > longest:
                    rows.append((names[begin], ids[begin], ",".join(map(str, ids[begin:i]))))
                    begin = i
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])

    return run


def _streamed_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node of a partition that is sorted by node and first id; only the state of one digest is held."""
    current, state = None, None

    def done(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends"])

    for batch in batches:
        rows = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != current:
                if current is not None:
                    rows.append((current, state.hexdigest()))
                current, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if rows:
            yield done(rows)
    if current is not None:
        yield done([(current, state.hexdigest())])


def ends_digests(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """node, ends: the digest of the ids that end at the node, ascending and joined by commas."""
    ids = nodes.select("node", F.explode("ends").alias("conv_id"))
    chunks = ids.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_ids(s.chunk), "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_streamed_digest, "node binary, ends string")


def with_parents(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds parent_conv, the smallest member of the parent, to the written table of global nodes."""
    known = nodes.select(F.col("node").alias("parent"), F.col("smallest").alias("parent_conv"), F.col("children").alias("siblings"))
    below = nodes.where(F.col("parent").isNotNull())
    hot = small(known.where(F.col("siblings") > s.hot))
    rest = known.where(F.col("siblings") <= s.hot)
    found = below.join(hot, "parent").unionByName(below.join(hot, "parent", "left_anti").join(rest, "parent"))
    return found.drop("siblings").unionByName(nodes.where(F.col("parent").isNull()).withColumn("parent_conv", F.lit(None).cast("long")))


def prefix_trie(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one (the root) included."""
    nodes = written(family_nodes(conversations, s), "trie-families")
    merged = nodes.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.sum("members").alias("members"), F.min("smallest").alias("smallest"), F.max("inner").alias("inner"),
    )
    merged = written(merged, "trie-merged")
    owned = merged.select((F.col("smallest") - F.col("smallest") % s.family).alias("family"), "node", "inner", "members", "chars")
    parts = nodes.select("family", "node", "parent", "depth").groupBy("family").cogroup(owned.groupBy("family")).applyInPandas(_family_sums, SUMS)
    sums = parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
    whole = merged.join(sums, "node", "left").join(ends_digests(nodes, s), "node", "left")
    whole = written(whole.na.fill(0, ["leaves", "saved", "children"]), "trie-whole")
    dropped(merged)
    dropped(nodes)
    return with_parents(whole, s).select(
        F.col("smallest").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
